import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from normloom.llm import split as S

texts = st.lists(st.sampled_from(["word ", "Câu kết thúc. ", "x" * 37, "\n", "\n\n", "; ", "1. ", "đoạn: ", "🗂️", "é"]), max_size=200).map("".join)


@settings(max_examples=150, deadline=None)
@given(texts, st.integers(30, 200), st.integers(0, 15))
def test_pieces(text, limit, overlap):
    parts = S.pieces(text, limit, overlap)
    assert "".join(text[own:end] for _, own, end, _ in parts) == text
    assert all(end - start <= limit for start, _, end, _ in parts)
    assert all(own - start == min(overlap, own) for start, own, _, _ in parts[1:])
    cuts = {c for level in S.boundaries(text) for c in level}
    assert all(natural == (own in cuts) for _, own, _, natural in parts[1:])
    for start, own, end, natural in parts[1:]:  # a forced cut only where the stretch has no boundary
        if not natural:
            assert not any(own - 1 < c < own + 1 for c in cuts)


@settings(max_examples=200, deadline=None)
@given(texts, st.integers(20, 150), st.integers(0, 15))
def test_class_against_brute_force(text, limit, overlap):
    stretches = re.split(r"\r\n|[\n\r\v\f\x85\u2028\u2029]|(?<=[.;:!?])\s", text)
    assert S.bisect(text, limit, overlap)[0] == ("forced" if max(map(len, stretches)) > limit else "natural")


def test_strongest_boundary_near_the_middle():
    text = "a" * 45 + ". " + "b" * 10 + "\n" + "c" * 10 + "\n\n" + "d" * 40
    assert S.pieces(text, 80, 0)[1][1] == text.index("d")


def test_rows(spark, rows):
    long = "Một câu dài. " * 200
    data = [("s1", "p/1", long, 1), ("s1", "p/1", long, 1), ("s2", None, "y" * 3000, 2), ("s3", "p", "short", 3), ("s4", "p", None, 4), ("s5", "p", "   ", 5), (None, "p", long, 6), ("s6", "p", "z" * 200_000, 7), ("s7", "p", "w" * 1200, 8)]
    df = spark.createDataFrame(data, "id string, citation_path string, text string, piece_no int")
    out = S.split_sections(df).collect()
    by = {}
    for r in out:
        by.setdefault(r["section_id"], []).append(r)
    assert {k: v[0]["cut_class"] for k, v in by.items()} == {"s1": "natural", "s2": "forced", "s6": "forced"}
    texts = {i: t for i, _, t, _ in data if i}
    for k, v in by.items():
        v.sort(key=lambda r: r["piece_no"])
        assert [r["piece_no"] for r in v] == list(range(1, len(v) + 1))
        assert "".join(texts[k][r["own_start"] : r["piece_end"]] for r in v) == texts[k]
        assert all(r["piece"] == texts[k][r["piece_start"] : r["piece_end"]] and len(r["piece"]) <= 1200 for r in v)
        assert all(a["piece"][-100:] == b["piece"][:100] for a, b in zip(v, v[1:]))
    assert {r["citation_path"] for r in by["s2"]} == {None}
    classes = {r["section_id"]: (r["cut_class"], r["n_pieces"], r["citation_path"]) for r in S.section_classes(df).collect()}
    assert classes == {k: (v[0]["cut_class"], len(v), v[0]["citation_path"]) for k, v in by.items()}
    made = {r["section_id"]: r for r in S.rebuilt(S.split_sections(df)).collect()}
    assert {k: (r["n_chars"], r["digest"], r["sound"]) for k, r in made.items()} == {k: (len(texts[k]), hashlib.md5(texts[k].encode()).hexdigest(), True) for k in by} and all(r["longest"] <= 1200 for r in made.values())
    other = spark.createDataFrame([("s1", "a", "y" * 1300, 1), ("s1", "b", long, 2)], df.schema)  # different copies: the longest counts
    assert [tuple(r)[:3] for r in S.section_classes(other).collect()] == [("s1", "b", "natural")] and {r["citation_path"] for r in S.split_sections(other).collect()} == {"b"}
    assert S.split_sections(df.limit(0)).collect() == [] == S.section_classes(df.limit(0)).collect()
