import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from normloom.llm import tokens as K

PATH = K.default_tokenizer()
TEXTS = ["Thông tư 12/2024", "", None, "🗂️ 已核对 №113 — ok", "<|endoftext|> plain", " \n\t ", "a" * 120_000, "đ" * 30_000]


def test_ids(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, other string")
    got = {r["doc_id"]: r["ids"] for r in K.encode(df, ["doc_id"]).collect()}
    assert len(got) == len(TEXTS) and got[1] == [] and got[2] == []
    assert all(K.decode(got[i], PATH) == (t or "") for i, t in enumerate(TEXTS))
    assert 50256 not in got[4]
    tiktoken = pytest.importorskip("tiktoken")
    public = pytest.importorskip("public_tokenizers")
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH.replace(".json", ".tiktoken"), "rb"))}
    other = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert all(got[i] == other.encode_ordinary(t or "") for i, t in enumerate(TEXTS) if len(t or "") < 50_000)
    counts = {r["doc_id"]: r["n_tokens"] for r in K.count_tokens(df, ["doc_id"]).collect()}
    assert counts == {i: len(x) for i, x in got.items()}
    assert all(r["same"] and r["covered"] for r in K.round_trip(df, ["doc_id"]).collect())
    assert K.encode(df.limit(0), ["doc_id"]).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_offsets(text):
    ids = K.load(PATH).encode(text, add_special_tokens=False).ids
    spans = K.char_offsets(ids, PATH)
    assert K.decode(ids, PATH) == text
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and (spans[-1][1] if spans else 0) == len(text)


def test_broken_ids_give_replacement_characters():
    first = K.load(PATH).encode("🗂", add_special_tokens=False).ids[:1]
    assert "�" in K.decode(first, PATH)
