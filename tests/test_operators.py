import itertools
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from normloom.operators import detect, evals, findings, graph, ingest, parsing, process, reports, search
from normloom.operators import validity as fold

T = lambda d: datetime(2024, 1, d)


def test_fold_is_independent_of_order(spark, rows):
    docs = spark.createDataFrame([("a", "in_force"), ("b", "repealed"), ("c", "in_force"), ("d", None)], "id string, status string")
    events = [("e1", "a", "amended", T(2)), ("e2", "a", "superseded", T(3)), ("e3", "b", "amended", T(2)), ("e4", "c", "repealed", T(2)), ("e5", "c", "amended", T(4)), ("e6", "a", "repealed", T(20)), ("e7", "zz", "amended", T(1)), ("e8", "a", None, T(1))]
    want = None
    for order in itertools.islice(itertools.permutations(events), 0, 4000, 1300):
        ev = spark.createDataFrame(list(order), "event_id string, target_id string, kind string, event_date timestamp")
        got = rows(fold.fold(docs, ev, F.lit(T(10))).select("id", "folded_status", "n_due"))
        want = want or got
        assert got == want == [("a", "superseded", 2), ("b", "repealed", 1), ("c", "repealed", 2), ("d", None, 0)]
    assert rows(fold.due_sweep(docs, ev, F.lit(T(10)), F.lit(T(20)))) == [("a", "superseded", "repealed")]


def test_pages(spark):
    df = spark.createDataFrame([(i, T(1 + i // 3)) for i in range(10)], "id int, d timestamp")
    seen, after = [], None
    while True:
        got = fold.page(df, [("d", True), ("id", True)], 4, after).collect()
        seen += [r["id"] for r in got[:4]]
        if len(got) <= 4:
            break
        after = (got[3]["d"], got[3]["id"])
    assert seen == list(range(9, -1, -1))


EDGE = "id string, source string, target string, edge_type string, promoted boolean, confidence double, created_at timestamp"


def edges(spark, data):
    return spark.createDataFrame([(f"{i:02}", s, t, k, p, 0.5, T(d)) for i, (s, t, k, p, d) in enumerate(data)], EDGE)


def test_chains(spark):
    line = [(f"n{i}", f"n{i + 1}", "derives", True, 1) for i in range(12)]
    e = edges(spark, [*line, ("n0", "x", "satisfies", True, 2), ("s", "s", "derives", True, 1), ("c1", "c2", "derives", True, 1), ("c2", "c1", "derives", False, 1), ("u", "v", "covers", True, 1)])
    starts = spark.createDataFrame([("n0",), ("s",), ("c1",), ("u",), ("n11",)], "node string")
    got = {r["start"]: [h["target"] for h in r["hops"]] for r in graph.chains(starts, e).collect()}
    assert got == {"n0": [f"n{i}" for i in range(1, 9)], "s": [], "c1": ["c2"], "u": [], "n11": ["n12"]}
    assert len(graph.chains(starts, e, 3).where("start = 'n0'").first()["hops"]) == 3
    law = lambda n: F.when(n.isin("n12", "c2"), "vn-reg").otherwise("local-sop")
    assert [tuple(r) for r in graph.covers(graph.chains(starts, e), law).collect() if r["source"] == "n11"] == [("n11", "n12")]


def test_references_and_evidence(spark, rows):
    named = spark.createDataFrame([("k", None, None, 1), ("k", "first", None, 2), ("k", "second", "d1", 3), ("k", "x", "d2", 4), ("s", None, None, 1), (None, "n", None, 1)], "ref_key string, label string, document_id string, seen int")
    refs = graph.ensure_refs(named)
    assert rows(refs) == [("k", "first", "d1"), ("s", None, None)]
    docs = spark.createDataFrame([("k", "other"), ("s", "d9")], "ref_key string, id string")
    assert rows(graph.resolve_stubs(refs, docs).select("ref_key", "document_id", "flipped")) == [("k", "d1", False), ("s", "d9", True)]
    ev = spark.createDataFrame([("e", 0.5, 1, "a"), ("e", 0.5, 2, "b"), ("e", None, 0, "c"), ("f", None, 1, "d")], "edge_id string, confidence double, seen int, kind string")
    assert rows(graph.best_evidence(ev).select("edge_id", "kind")) == [("e", "a"), ("f", "d")]


def test_findings(spark, rows):
    e = edges(spark, [("p1", "l1", "satisfies", True, 5), ("p2", "l1", "satisfies", True, 3), ("p1", "s1", "implements", True, 1)])
    amended = spark.createDataFrame([("l1", T(5))], "node string, amended_on timestamp")
    assert [r["node"] for r in findings.stale(e, amended).collect()] == ["p2"]  # the same day isn't stale
    nodes = spark.createDataFrame([("p1", "local-policy"), ("p3", "local-policy")], "node string, corpus_id string")
    gaps = findings.gaps(nodes, e, [("local-policy", "out", "satisfies", "no_satisfies")])
    assert [r["node"] for r in gaps.collect()] == ["p3"]
    assert findings.new_findings(gaps, gaps, ["node"]).collect() == [] and findings.new_findings(gaps.unionByName(gaps), gaps.limit(0), ["node"]).count() == 1
    assert rows(findings.conflicts(e).select("source", "law", "standard")) == [("p1", "l1", "s1")]
    g = spark.createDataFrame([(0.7, 0.6), (0.69, 0.9), (None, 0.9), (0.9, float("nan"))], "confidence double, grounding_score double")
    assert [r[0] for r in g.select(findings.gate()).collect()] == [True, False, False, False]
    act = spark.createDataFrame([("00", "promote", None, 1), ("01", "reject", None, 1), ("02", "reject", None, 1), ("02", "relink", "s9", 2), ("99", "reject", None, 1)], "id string, action string, new_target string, seen int")
    assert rows(findings.apply_review(e, act).select("id", "target", "confidence")) == [("00", "l1", 1.0), ("02", "s9", 0.5)]
    refs = spark.createDataFrame([([("c", "d", None)], "k1"), ([("c", "d", "s")], "k2"), ([], "k3")], "node_refs array<struct<corpus_id:string,document_id:string,section_id:string>>, k string")
    assert rows(findings.about_node(refs, "c", "d").select("k")) == [("k1",), ("k2",)] and rows(findings.about_node(refs, "c", "d", "s").select("k")) == [("k2",)]


def test_roles(spark, rows):
    h = spark.createDataFrame([("r", "ann", T(1), T(5)), ("r", "bob", T(5), T(8)), ("r", "eve", T(9), None)], "role string, holder string, from_date timestamp, to_date timestamp")
    m = spark.createDataFrame([("r", i, T(d)) for i, d in enumerate((1, 4, 5, 8, 9, 30))] + [("x", 9, T(1))], "role string, moment_id int, moment timestamp")
    assert {r["moment_id"]: r["holder"] for r in reports.holder_at(h, m, "role").collect()} == {0: "ann", 1: "ann", 2: "bob", 3: None, 4: "eve", 5: "eve", 9: None}


def test_evaluation(spark):
    exp = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z"), ("d", None)], "case_id string, item string")
    hits = spark.createDataFrame([("a", "q", 1, True), ("a", "x", 2, True), ("a", "r", 3, False), ("c", "x", 1, False), ("a", "x", 4, False)], "case_id string, item string, rank int, current boolean")
    got = {r["case_id"]: (r["recall"], r["reciprocal_rank"], r["in_force_precision"]) for r in evals.retrieval(exp, hits).collect()}
    assert got == {"a": (0.5, 0.5, 1.0), "b": (0.0, 0.0, None), "c": (None, None, 0.0)}
    total = evals.roll_up(evals.retrieval(exp, hits)).first()
    assert total["recall"] == round(1 / 3, 9) and total["mrr"] == 0.25
    assert [r["metric"] for r in evals.failing(evals.roll_up(evals.retrieval(exp, hits)), {"recall": 0.9, "mrr": 0.0, "precision": 0.1}).collect()] == ["recall"]
    ab = spark.createDataFrame([("a", True, 0, None), ("b", True, 2, 0.1), ("c", False, 2, 0.9)], "case_id string, expect_abstain boolean, n_hits int, top_score double")
    assert [r["correct"] for r in evals.abstention(ab, 0.5).orderBy("case_id").collect()] == [True, True, True]
    assert [r["correct"] for r in evals.abstention(ab).orderBy("case_id").collect()] == [True, False, True]


def test_ingest(spark, rows):
    found = spark.createDataFrame([("a", "h1"), ("b", "h1"), ("c", "h1"), (" ", "h")], "external_id string, content_hash string")
    led = spark.createDataFrame([("a", "h1", "indexed"), ("b", "h1", "failed"), ("c", "old", "indexed")], "external_id string, content_hash string, state string")
    assert rows(ingest.to_process(found, led).select("external_id")) == [("b",), ("c",)]
    old = spark.createDataFrame([("s", T(5)), ("t", T(5)), ("u", T(5))], "source string, watermark timestamp")
    seen = spark.createDataFrame([("s", T(9), None, True), ("t", T(9), None, False), ("u", T(1), None, True), ("v", None, T(3), True)], "source string, issued timestamp, published timestamp, complete boolean")
    assert {r["source"]: r["watermark"] for r in ingest.watermark(old, seen, "source").collect()} == {"s": T(9), "t": T(5), "u": T(5), "v": T(3)}
    ex = spark.createDataFrame([("d1", "n1", "u1", "old"), ("d2", None, "u2", "old"), ("d3", "n3", None, "keep")], "id string, doc_number string, source_url string, title string")
    new = spark.createDataFrame([("x1", "n1", "u9", "new", 1), ("x2", None, "u2", "new", 1), ("x3", "n9", None, "first", 1), ("x3", "n9", None, "last", 2)], "new_id string, doc_number string, source_url string, title string, seen int")
    assert rows(ingest.upsert(ex, new, ["id", "doc_number", "source_url", "title"]).select("id", "title")) == [("d1", "new"), ("d2", "new"), ("d3", "keep"), ("x3", "last")]
    new = spark.createDataFrame(
        [("x1", "n9", None, "a", 1), ("x2", "n9", "u9", "b", 2), ("x3", None, "u9", "c", 3), ("x4", "", "", "d", 4), ("x5", "", "", "e", 5), ("x6", "n7", "u2", "f", 6), ("x7", "n7", None, "g", 7), ("x8", "n8", "u9", "h", 8)],
        "new_id string, doc_number string, source_url string, title string, seen int",
    )
    assert rows(ingest.upsert(ex, new, ["id", "doc_number", "source_url", "title"]).select("id", "title")) == [("d1", "old"), ("d2", "g"), ("d3", "keep"), ("x1", "h"), ("x4", "d"), ("x5", "e")]
    assert ingest.upsert(ex, new.limit(0), ["id", "title"]).count() == 3 and ingest.upsert(ex.limit(0), new, ["id", "title"]).count() == 4
    sec = spark.createDataFrame([("s1", "d1", [1.0]), ("s2", "d2", [1.0])], "id string, document_id string, embedding array<float>")
    assert rows(ingest.replace_sections(sec, sec.where("id = 's1'").withColumn("id", F.lit("s9")), 1).select("id")) == [("s2",), ("s9",)]
    with pytest.raises(Exception, match="dimensions"):
        ingest.replace_sections(sec, sec, 2).collect()
    files = spark.createDataFrame([([("other", "a.pdf"), ("main", "b.html")],), ([("x", "c.docx")],), ([],)], "files array<struct<kind:string,name:string>>")
    assert [r[0] for r in files.select(ingest.content_type(ingest.main_file(F.col("files"))["name"])).collect()][:1] == ["text/html"]
    rel = spark.createDataFrame([("r", 2, 1, "i", None, "t"), ("r", 1, 1, "i", "n", None), ("r", 1, 2, "", " ", ""), ("r", 1, 3, None, None, "t")], "record_id string, group_no int, position int, target_id string, target_number string, target_title string")
    assert rows(ingest.merge_relations(rel).select("group_no", "position", "relation_key")) == [(1, 1, "i"), (1, 3, "t")]


def test_search(spark, rows):
    data = [(i, "c1" if i % 2 else "c2", "hồ sơ " * (i % 3) + "khác", [1.0, i / 10.0] if i % 4 else None, i % 5 != 0) for i in range(20)]
    df = spark.createDataFrame(data, "section_id int, corpus_id string, text string, embedding array<float>, ok boolean")
    hits = search.hybrid_search(df, "hồ sơ", [1.0, 0.0], 4, F.col("ok")).collect()
    assert len(hits) == 4 and all(data[h["section_id"]][4] for h in hits) and [h["score"] for h in hits] == sorted((h["score"] for h in hits), reverse=True)
    assert len(search.hybrid_search(df, "hồ sơ", [1.0, 0.0], 0).collect()) == 10
    assert search.hybrid_search(df.limit(0), "hồ sơ", [1.0, 0.0]).collect() == []
    posted = search.lexical_index(df, "section_id", ["corpus_id"])
    by_text, by_index = (search.hybrid_search(df, '"hồ sơ" -khác2', [1.0, 0.0], 6, F.col("ok"), postings=p) for p in (None, posted))
    assert rows(by_text) == rows(by_index) and by_text.count() == 6
    near = search.vector_multi_query(df.select(F.col("section_id").alias("item_id"), "embedding"), df.where("section_id in (1, 6)").select(F.col("section_id").alias("query_id"), "embedding"), 2, block=3)
    assert rows(near.where("place = 1").select("query_id", "item_id")) == [(1, 1), (6, 6)] and near.count() == 4
    c = df.select(F.col("section_id").alias("id"), "embedding", F.lit("in_force").alias("validity_status"), "text")
    found = detect.rerank(detect.candidates(c.where("id = 1"), c, 3), 3)
    text = lambda n: c.select(F.col("id").alias(f"{n}_id"), F.col("text").alias(f"{n}_text"))
    pairs = found.join(text("source"), "source_id").join(text("target"), "target_id")
    assert detect.relations(pairs).count() == 3 and detect.relations(pairs, min_confidence=0.9).count() == 0


VN = """Lời mở đầu bị bỏ.
Chương I
QUY ĐỊNH CHUNG
Điều 1. Phạm vi
1. Khoản một.
a) Điểm a;
đ) Điểm đ.
2. Khoản hai sửa như sau:
“Điều 9. Không phải tiêu đề
1. Trong ngoặc.”
Điều 5 của luật này được áp dụng.
Điều 2. Hiệu lực
Có hiệu lực ngay.
Điều 2. Lặp lại
Phần thân.
PHỤ LỤC 01
Danh mục"""

MY = """ARRANGEMENT OF SECTIONS
1. Short title
ENACTED by the Parliament as follows:
PART I
PRELIMINARY
1. (1) This Act may be cited.
(2) It applies to
(a) banks;
(h) one;
(i) letter i;
(ii) roman two;
12
2. Next section.
7. Not a section.
2A. Inserted section.
FIRST SCHEDULE
1. Not a section either."""


def test_vietnamese_law():
    got = [(k, p) for k, p, _, _ in parsing.parse_vn(VN)]
    assert got == [
        ("clause", "chuong-i/dieu-1/khoan-1"), ("point", "chuong-i/dieu-1/khoan-1/diem-a"), ("point", "chuong-i/dieu-1/khoan-1/diem-dd"), ("clause", "chuong-i/dieu-1/khoan-2"),
        ("article", "chuong-i/dieu-2"), ("article", "chuong-i/dieu-2~2"), ("appendix", "phu-luc-01"),
    ]
    rows = {p: (h, t) for _, p, h, t in parsing.parse_vn(VN)}
    assert rows["chuong-i/dieu-2"] == ("Chương I — QUY ĐỊNH CHUNG > Điều 2 — Hiệu lực", "Có hiệu lực ngay.")
    assert "Không phải tiêu đề" in rows["chuong-i/dieu-1/khoan-2"][1] and "Điều 5 của luật" in rows["chuong-i/dieu-1/khoan-2"][1]
    assert [p for _, p, _, _ in parsing.parse_vn("1. Một.\nthêm\n1.1. Con.\n2. Hai.")] == ["khoan-1", "khoan-1/khoan-1", "khoan-2"]
    assert parsing.parse_vn("\n".join(["dòng chữ dài " * 8] * 4))[0][1] == "toan-van" and parsing.parse_vn("ngắn") == [] == parsing.parse_vn(None)
    assert [p for _, p, _, _ in parsing.parse_vn("**1. Tiêu đề**\nnội dung")] == ["dieu-1"]
    appendices = {"Phụ Lục 01": "phu-luc-01", "PHỤ LỤC IIa.": "phu-luc-iia", "phụ lục số 2:": "phu-luc-2", "Phụ lục": "phu-luc", "PHỤ LỤC 3 DANH MỤC": "phu-luc-3"}
    for line, path in appendices.items():
        assert [p for _, p, _, _ in parsing.parse_vn(f"Điều 1. A\nb\n{line}\nNội dung\nthêm")][1:] == [path], line
    assert len(parsing.parse_vn("Điều 1. A\nb\nPhụ lục 01 ban hành kèm theo.")) == 1
    assert [p for _, p, _, _ in parsing.parse_vn("IV - Chung\nA. Riêng\n1. Một\nb) Hai")] == ["muc-iv/muc-a/khoan-1", "muc-iv/muc-a/khoan-1/diem-b"]


def test_malaysian_law():
    assert [p for _, p, _, _ in parsing.parse_my(MY)] == [
        "part-i/section-1/subsection-1", "part-i/section-1/subsection-2", "part-i/section-1/subsection-2/para-a", "part-i/section-1/subsection-2/para-h", "part-i/section-1/subsection-2/para-i",
        "part-i/section-1/subsection-2/para-i/sub-ii", "part-i/section-2", "part-i/section-2a", "schedule-first",
    ]
    assert "Not a section." in dict((p, t) for _, p, _, t in parsing.parse_my(MY))["part-i/section-2"]
    assert parsing.parse_my("plain text")[0][1] == "fulltext" and parsing.parse_my("") == [] == parsing.parse_my(None)


def test_trees(spark):
    tree = [{"key": "Điều 1", "title": "Điều 1", "level": "Điều", "content": {"content": "<p>Điều 1. Chung</p><p>Khoản một</p>"}, "children": [{"key": "1", "title": "1", "ptype": 6, "content": {"content": "<p>Khoản một</p>"}}]}, {"level": "?", "children": [{"key": "2", "level": "Điều", "title": "Điều 2", "content": {"content": "Hai"}}]}]
    for payload in (json.dumps(tree), json.dumps({"data": tree})):
        assert [(p, t) for _, p, _, t in parsing.parse_tree(payload)] == [("dieu-1", "Chung"), ("dieu-1/khoan-1", "Khoản một"), ("dieu-2", "Hai")]
    assert parsing.parse_tree("{") == [] == parsing.parse_tree(None) == parsing.parse_tree("[]")
    assert parsing.choose_vn("[]", VN) == parsing.parse_vn(VN)
    layout = {"document": {"documentLayout": {"blocks": [{"textBlock": {"text": "T", "type": "title", "blocks": [{"textBlock": {"text": "body", "type": "paragraph"}}]}}, {"tableBlock": {"bodyRows": [{"cells": [{"blocks": [{"textBlock": {"text": "a"}}]}, {"blocks": [{"textBlock": {"text": "b"}}]}]}]}}]}}}
    assert parsing.parse_layout(json.dumps(layout)) == [("heading", "h-1", "T", "body\na | b")]
    df = spark.createDataFrame([(1, VN, 0), (2, None, 0), (3, "", 0)], "doc_id bigint, text string, position int")
    out = parsing.sections(df, "vn").collect()
    assert {r["doc_id"] for r in out} == {1} and [r["position"] for r in out] == list(range(7)) and all(r["error"] is None for r in out)


def test_every_document_meets_one_parser(spark, tmp_path):
    from normloom.plans import reference

    text = "Điều 1. Phạm vi\nNội dung.\nSection 1 Scope\nText."
    kinds = [("vi", "agc"), ("en", "vbpl"), ("ms", None), (None, "agc"), (None, "vbpl"), (None, None), ("", "minutes"), ("fr", "agc")]
    docs = spark.createDataFrame([(i, text, lang, source) for i, (lang, source) in enumerate(kinds)], "doc_id bigint, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    vn, my = ({r["doc_id"] for r in reference.queries()[q](spark, str(tmp_path)).collect()} for q in ("vn_parse", "my_parse"))
    assert vn == {0, 4, 5, 6} and my == {1, 2, 3, 7}


def test_header_references_become_edges(spark, rows):
    from normloom.functions import tiers

    refs = "array<struct<relation:string,target_number:string,target_title:string,quoted_span:string>>"
    headers = spark.createDataFrame(
        [("local-policy", "p1", "ann", [("Implements ", " STD-1 ", None, "q1"), ("implements", "", "By title", "q2"), ("cites", "STD-1", None, "q3"), ("implements", None, " ", "q4"), ("derives", "STD-1", None, "q5")]),
         ("local-sop", "s1", None, [("derives from", "POL-1", "Policy", "q6")]), ("reports", "r1", None, [("implements", "STD-1", None, "q7")]), ("local-sop", "s2", None, None), ("local-sop", "s3", None, [])],
        f"corpus_id string, doc_id string, owner string, refs {refs}",
    )
    docs = spark.createDataFrame([("group-std", "STD-1", "d9"), ("group-std", "STD-1", "d2"), ("my-reg", "POL-1", "x"), ("group-std", None, "n")], "corpus_id string, doc_number string, id string")
    new = graph.extract_edges(headers, docs, tiers.edge_pairs(spark))
    assert rows(new.select("from_document", "to_corpus", "to_document", "ref_key", "edge_type", "created_by")) == [
        ("p1", "group-std", "d2", "group-std:STD-1", "implements", "ann"), ("p1", "group-std", None, "group-std:BY TITLE", "implements", "ann"), ("s1", "local-policy", None, "local-policy:POL-1", "derives", None),
    ]
    new = new.withColumn("seen", F.col("quoted_from"))
    none = new.select(graph.edge_id().alias("id"), *graph.EDGE_KEY, "to_corpus", "direction", F.lit(False).alias("promoted"), "seen").limit(0)
    once = graph.write_edges(none, new.unionByName(new))
    again = graph.write_edges(once.withColumn("promoted", F.lit(True)), new)
    assert once.count() == 3 == again.count() and {r["promoted"] for r in again.collect()} == {True} and rows(once.select("id")) == rows(again.select("id"))
    with pytest.raises(Exception, match="no edge may lead"):
        graph.write_edges(none, new.withColumn("to_corpus", F.lit("reports"))).collect()
    ev = graph.extracted_evidence(new)
    assert graph.write_evidence(graph.write_evidence(ev.limit(0), ev), ev.withColumn("confidence", F.lit(0.1))).where("confidence = 1").count() == 3
    assert [len(r["evidence"]) for r in graph.with_evidence(once, ev.limit(0)).collect()] == [0, 0, 0]


def test_citations_and_answers(spark):
    exp = spark.createDataFrame([("a", "12/2024/tt", ["Điều 5"]), ("a", "12/2024/TT", None), ("b", "X", []), ("c", None, ["y"])], "case_id string, doc_number string, segments array<string>")
    hits = spark.createDataFrame([("a", 1, "9/2024/TT", "dieu-5", "Điều 5", True), ("a", 2, "12/2024/TT", "dieu-5", "Điều 5".replace("ề", "ê\u0300"), True), ("a", 3, None, None, "12/2024/TT", False), ("d", 1, "q", None, None, True)], "case_id string, rank int, doc_number string, citation_path string, heading_path string, current boolean")
    got = {r["case_id"]: (r["n_found"], r["recall"], r["reciprocal_rank"], r["precision"], r["in_force_precision"]) for r in evals.retrieval_by_citation(exp, hits).collect()}
    assert got["a"] == (2, 1.0, 0.5, 2 / 3, 1.0) and got["b"] == (0, 0.0, 0.0, None, None) and got["d"][1] is None and got["d"][3] == 0.0
    qa = spark.createDataFrame([("answer", "answer", "5", ["dieu-5"]), ("answer", "answer", "7", ["dieu-5"]), ("answer", "answer", None, None), ("abstain", "abstain", None, []), ("abstain", "answer", "x", [])], "expected_kind string, kind string, expected_contains string, citations array<string>")
    assert tuple(evals.answers(qa).first()) == (5, 0.8, 3, round(2 / 3, 9)) and tuple(evals.answers(qa.limit(0)).first()) == (0, 1.0, 0, 1.0)


def test_process(spark, rows):
    good = "Văn bản tiếng Việt đầy đủ dấu và đủ dài để dùng. " * 5
    data = [("a", "h", good), ("b", "h", good), ("c", "h", None), ("d", "h", " "), ("e", "h", "ngắn"), ("f", "h", good), ("g", "h2", good)]
    r = spark.createDataFrame([(*d, "clash") for d in data], "external_id string, content_hash string, text string, outcome string")
    ledger = spark.createDataFrame([("a", "h", "indexed"), ("a", "h", "indexed"), ("b", "h", "failed"), ("g", "h", "indexed")], "external_id string, content_hash string, state string")
    out = process.outcomes(r, ledger, in_scope=F.col("external_id") != "f")
    assert rows(out.select("external_id", "outcome")) == [("a", "skipped"), ("b", "indexed"), ("c", "failed"), ("d", "failed"), ("e", "low_quality"), ("f", "out_of_scope"), ("g", "indexed")]
    assert process.outcomes(r.limit(0), ledger).collect() == []
    rel = "array<struct<label:string,target_number:string>>"
    rec = spark.createDataFrame([("x", T(3), T(1), [("amends", " n1 "), ("cites", "n1"), ("replaces", " ")]), ("y", None, T(2), [("repeals", "n2")]), ("z", None, None, None)], f"external_id string, effective_date timestamp, issued_date timestamp, relations {rel}")
    events = process.relation_events(rec)
    assert rows(events) == [("x", "n1", "amended", T(3)), ("y", "n2", "repealed", T(2))]
    resolved, pending = process.with_targets(events, spark.createDataFrame([("d1", "n1")], "id string, doc_number string"))
    assert rows(resolved.select("external_id", "target_id")) == [("x", "d1")] and rows(pending.select("external_id")) == [("y",)]
    assert rows(process.with_targets(pending, spark.createDataFrame([("d2", "n2")], "id string, doc_number string"))[0].select("target_id")) == [("d2",)]  # once its target has come in
    docs = spark.createDataFrame([("vn-reg", "1", None, "HHL", ""), ("my-reg", "", "u", None, None), ("odd", "1", None, None, "ms"), ("vn-reg", " ", "", None, None)], "corpus_id string, number string, url string, status string, language string").withColumn("effective_date", F.lit(None).cast("date"))
    got = [(r["error"], r["language"], r["validity_status"]) for r in process.documents(docs, F.current_date()).collect()]
    assert got == [(None, "vi", "repealed"), (None, "en", "in_force"), ("unregistered corpus", "ms", "in_force"), ("neither number nor url", "vi", "in_force")]
