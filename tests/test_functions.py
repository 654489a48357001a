import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from normloom.functions import text as X
from normloom.functions import tiers as T
from normloom.functions import validity as V
from normloom.functions import vectors as E


def test_tiers(spark):
    for role, want in (("", ["vn-reg"]), ("public", ["vn-reg"]), ("group", ["group-std", "vn-reg"]), ("local", ["group-std", "local-sop", "unknown", "vn-reg"])):
        df = spark.createDataFrame([("vn-reg", T.PUBLIC), ("vn-reg", T.LOCAL), ("group-std", T.GROUP), ("group-std", None), ("local-sop", T.LOCAL), ("unknown", "odd")], "c string, t string")
        assert sorted(r["c"] for r in df.where(T.row_visible(role, F.col("c"), F.col("t"))).collect()) == want
    with pytest.raises(ValueError):
        T.role_rank("root")
    df = spark.createDataFrame([(["vn-reg"],), (["vn-reg", "group-std"],), (["vn-reg", None],), ([],), (None,)], "c array<string>")
    assert [r[0] for r in df.select(T.strictest(F.col("c"))).collect()] == [T.PUBLIC, T.GROUP, T.LOCAL, T.LOCAL, T.LOCAL]
    pair = spark.createDataFrame([(T.PUBLIC, T.GROUP), (T.LOCAL, T.GROUP), ("odd", T.LOCAL)], "a string, b string")
    assert [r[0] for r in pair.select(T.stricter_tier(F.col("a"), F.col("b"))).collect()] == [T.GROUP, T.LOCAL, "odd"]
    assert T.registry(spark).count() == 7
    with pytest.raises(ValueError):
        T.registry(spark, (T.Corpus("vn-reg", "law", T.PUBLIC, None, False, True, "", None),))
    with pytest.raises(ValueError):
        T.registry(spark, (T.Corpus("new", "law", T.PUBLIC, None, False, True, "", None, 3),))
    targets = ("vn-reg", "my-reg", "group-std", "local-policy")
    want = {("local-sop", "local-policy"): "derives", ("local-policy", "group-std"): "implements", ("local-policy", "vn-reg"): "satisfies", ("group-std", "my-reg"): "satisfies"}
    want |= {(a, b): "concerns" for a in ("reports", "diagrams") for b in targets}
    assert {(p["from_corpus"], p["to_corpus"]): p["edge_type"] for p in T.edge_pairs(spark).collect()} == want


def test_validity(spark):
    df = spark.createDataFrame([("Còn hiệu lực ", None), ("HHL", None), ("?", "2024-01-01"), ("?", "2025-01-01"), (None, None)], "raw string, eff string").withColumn("eff", F.col("eff").cast("date"))
    assert [r[0] for r in df.select(V.map_validity(F.col("raw"), F.col("eff"), F.expr("DATE '2024-01-01'"))).collect()] == ["in_force", "repealed", "in_force", "not_yet_effective", "in_force"]
    codes = {"in_force": "chl principal", "amended": "partial HHL1P hhl1phan", "repealed": "expired suspended HHL tdhl repealed", "not_yet_effective": "not_yet cchl TNHL chuacohieuluc"}
    codes = [(w, k) for k, v in codes.items() for w in v.split()] + [("Tạm dừng hiệu lực", "repealed"), ("\u00a0chưa có hiệu lực\n", "not_yet_effective"), ("Hết hiệu lực một phần", "amended"), ("amended", "in_force")]
    df = spark.createDataFrame(codes, "raw string, want string").withColumn("eff", F.lit(None).cast("date"))
    assert [r for r in df.select("raw", "want", V.map_validity(F.col("raw"), F.col("eff"), F.expr("DATE '2024-01-01'")).alias("got")).collect() if r["want"] != r["got"]] == []
    labels = {"amended": "Amends amend amends_supplements corrects correction", "superseded": "replaces replace supersedes supersede superseded", "repealed": "repeals repeal abrogates abrogate"}
    labels = [(w, k) for k, v in labels.items() for w in v.split()] + [(w, None) for w in ("cites", "legal_basis", "consolidates", "pua", "thay thế", "", None)]
    got = spark.createDataFrame(labels, "l string, want string").select("want", V.event_kind(F.col("l")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
    spans = spark.createDataFrame([("2024-01-01", "2024-02-01")], "e string, x string").select(F.col("e").cast("date"), F.col("x").cast("date"))
    at = lambda d: spans.select(V.as_of(F.col("e"), F.col("x"), F.expr(f"DATE '{d}'"))).first()[0]
    assert at("2024-01-01") and at("2024-01-31") and not at("2024-02-01") and not at("2023-12-31")
    step = spark.createDataFrame([("repealed", "amended"), ("in_force", "repealed"), ("amended", "superseded"), ("in_force", "odd")], "s string, k string")
    assert [r[0] for r in step.select(V.transition(F.col("s"), F.col("k"))).collect()] == ["repealed", "repealed", "superseded", "in_force"]


QUERIES = [
    ("alpha beta", lambda w: "alpha" in w and "beta" in w),
    ('"alpha beta"', lambda w: any(a == "alpha" and b == "beta" for a, b in zip(w, w[1:]))),
    ("alpha or beta", lambda w: "alpha" in w or "beta" in w),
    ("alpha -beta", lambda w: "alpha" in w and "beta" not in w),
    ('-"alpha beta" gamma', lambda w: "gamma" in w and not any(a == "alpha" and b == "beta" for a, b in zip(w, w[1:]))),
    ("", lambda w: False),
    ('"" -', lambda w: False),
]


def test_queries(spark):
    r = random.Random(1)
    texts = [" ".join(r.choices(["Alpha", "beta,", "GAMMA", "x"], k=r.randrange(6))) for _ in range(60)] + [None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("w", X.tokens(F.col("t")))
    words = {x["i"]: x["w"] for x in df.collect()}
    for q, want in QUERIES:
        assert {x["i"] for x in df.where(X.query_predicate(q, F.col("w"))).collect()} == {i for i, w in words.items() if want(w)}, q


def test_text(spark):
    assert X.html_text("<p>a&nbsp;b</p><script>x</script><td>c</td><td>d</td><br>e  f") == "a b\nc d\ne f" and X.html_text(None) is None
    assert X.html_text("<main><nav>menu</nav>a</main>x") == "menu\na\nx"
    assert X.html_text("<head><title>t</title><body>b<iframe>i</iframe><object>o<p>p</p></object><dl><dt>q</dt></dl>r<figure>f</figure>one\ntwo") == "b\nq\nr\nf\none two"
    good = ["Điều 1. Ngân hàng Nhà nước Việt Nam quy định các điều kiện sau đây. Khoản 1 áp dụng. " * 10, "NGÂN HÀNG NHÀ NƯỚC VIỆT NAM ban hành quyết định này. " * 10]
    english = "This is a long plain English text without any accents at all. " * 10
    fine = "Văn bản tốt có dấu. " * 20
    bad = [("", "empty text"), (None, "empty text"), ("ít chữ", "too few letters"), (english, "hardly any accents"), (fine + "\ue001" * 20, "private-use characters"), (fine + "\ufffd" * 20, "unreadable characters"),
           ("C√¥ng ∆∞·ªõc th√¥ng qua nh·ªØng ƒëi·ªÅu sau " * 12, "mojibake"), ("Дҗiб»Ғu 1. Hб»“ sЖЎ Д‘б»Ғ nghб»Ӣ " * 12, "Cyrillic")]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*good, *[t for t, _ in bad]])], "i int, t string").withColumn("ok", F.lit("clash"))
    got = {r["i"]: r for r in X.with_quality(df, "t", F.lit(True)).collect()}
    assert all(got[i]["ok"] and got[i]["confidence"] >= 0.6 and got[i]["reason"] is None for i in range(len(good)))
    for i, (_, reason) in enumerate(bad, len(good)):
        assert not got[i]["ok"] and reason in got[i]["reason"], (reason, got[i])
    assert X.with_quality(spark.createDataFrame([(english,)], "t string"), "t", F.lit(False)).first()["ok"]
    df = spark.createDataFrame([(["a", "x", "b", "a", "b"],), (["a"],), (None,), ([],), (["b", None, None, "a"],)], "w array<string>")
    assert [round(r[0], 6) for r in df.select(X.cover_density([["a"], ["b"]], F.col("w"))).collect()] == [0.25, 0.0, 0.0, 0.0, round(0.1 / 3, 6)]
    assert [round(r[0], 6) for r in df.select(X.cover_density([["a", "b"]], F.col("w"))).collect()] == [0.4, 0.1, 0.0, 0.0, 0.2]
    fold = spark.createDataFrame([("Điều KHOẢN",), (None,), ("Điều khoản".replace("ề", "ê\u0300"),)], "t string")
    assert [r[0] for r in fold.select(X.fold_marks("t")).collect()] == ["dieu khoan", None, "dieu khoan"] and [r[0] for r in fold.select(X.fold_nfc("t")).collect()] == ["điều khoản", None, "điều khoản"]
    e = spark.createDataFrame([("alpha beta",), ("beta alpha",), ("alpha",), (None,), ("!!",)], "t string").select(X.embedder(16)("t").alias("v")).collect()
    assert e[0]["v"] == e[1]["v"] != e[2]["v"] and e[3]["v"] is None and len(e[4]["v"]) == 16 and abs(sum(x * x for x in e[0]["v"]) - 1) < 1e-5


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_html_and_query_never_fail(text):
    X.html_text(text)
    X.parse_query(text)


def test_scope(spark):
    import unicodedata

    words = X.scope_vocabulary([("An ninh", "strong"), ("hạn mức", "strong_title"), ("hệ thống", "weak"), ("ngân hàng", "signal"), ("x", "odd")])
    data = [
        ("1/NHNN", "hệ thống", None, ["hệ thống"]), ("1", "hệ thống ngân hàng", "", ["hệ thống"]), ("1", "hệ thống", "ngân hàng", []), (None, unicodedata.normalize("NFD", "AN NINH"), None, ["an ninh"]), ("2", "an", "ninh", []), ("an", "ninh", None, []),
        ("3", None, "An ninh và hạn mức", ["an ninh"]), ("hạn", "mức", None, []), (None, None, None, []),
    ]
    df = spark.createDataFrame([d[:3] for d in data], "n string, t string, a string")
    assert [r[0] for r in df.select(X.scope_terms(F.col("n"), F.col("t"), F.col("a"), *words)).collect()] == [d[3] for d in data]
    asked = spark.createDataFrame([("an ninh mang",), ("An Ninh mạng",), ("han muc",), ("he thong ngan hang",), ("hạn muc",), (None,)], "q string")
    assert [r[0] for r in asked.select(X.scope_query_terms(F.col("q"), *words)).collect()] == [["an ninh"], ["an ninh"], ["hạn mức"], ["hệ thống"], [], []]


def test_vectors(spark, rows):
    df = spark.createDataFrame([(1, "p", [1.0, 0.0]), (2, "p", [0.0, 1.0]), (3, "p", [1.0, 0.0]), (4, "q", [0.5, 0.5]), (5, "q", None), (6, "q", [0.0, 0.0]), (7, "q", [1.0])], "k int, g string, embedding array<float>")
    assert [(r["g"], r["k"], r["rank_v"]) for r in E.top_k(df, [1.0, 0.0], 2, "g", "k").orderBy("g", "rank_v").collect()] == [("p", 1, 1), ("p", 3, 2), ("q", 4, 1)]
    b = {r["k"]: r["buckets"] for r in E.hyperplane_buckets(df.where("k in (1, 2, 3)"), 2, 6, 3).collect()}
    assert b[1] == b[3] and len(b[1]) == 3
