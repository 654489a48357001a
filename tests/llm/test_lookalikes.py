import itertools
import threading
import unicodedata

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from normloom.llm import lookalikes as L

PLAIN = "Quyết định 12/2024/QĐ-VTS về khóa mã"
ALIKE = [
    PLAIN,
    unicodedata.normalize("NFD", PLAIN),
    "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in PLAIN),
    PLAIN.replace(" ", " "),
    PLAIN.replace(" ", "　"),
    PLAIN.replace("ị", "ị­").replace("2", "​2‍"),
    PLAIN.replace("a", "а").replace("T", "Τ").replace("S", "Ѕ"),
    PLAIN.replace("Đ", "Ð").replace("-", "‑").replace("/", "∕"),
    unicodedata.normalize("NFD", PLAIN).replace("o", "ο").replace("e", "е"),
]
OTHER = [PLAIN.lower(), PLAIN.replace("12", "012"), PLAIN.replace("/", "-"), PLAIN.replace(" ", "  "), PLAIN.replace("ế", "e"), PLAIN + " thêm", "", " "]


def canonical(values):
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INTEGER, v VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(values)))
    return [r[0] for r in con.execute(f"SELECT {L.canonical_sql('v')} FROM t ORDER BY i").fetchall()]


def test_forms():
    assert set(canonical(ALIKE)) == {unicodedata.normalize("NFC", PLAIN)}
    forms = canonical([PLAIN, *OTHER])
    assert len(set(forms)) == len(forms)
    assert canonical(["​", "'ﬁ'", None][:1]) == [""]


def test_forms_of_several_characters(spark):
    want = {"ﬁnal": "final", "Chương Ⅱ": "Chương II", "Chương Ⅳ và Ⅰ": "Chương IV và I", "№ 5": "No 5", "12㎏": "12kg", "hết…": "hết...", "ｶﾞ": "ガ", "⑴ ⒈": "(1) 1.", "ĳ": "ij"}
    assert canonical(list(want)) == list(want.values())
    visible = ["x²", "①", "½", "´", "¨"]
    assert canonical(visible) == visible


def test_letters_by_rule(spark):
    """Letters that only ICU's confusables know."""
    assert canonical(["ᎪᏴ", "Ⲟ", "ꓮ", "Сop", "пш"]) == ["AB", "O", "ꓮ", "Cop", "пш"]
    assert len(L._confusables(spark)) > 60 and all(len(v) == 1 and v.isascii() for v in L._confusables(spark).values())
    assert all(k.isupper() == v.isupper() for k, v in L._confusables(spark).items())


def test_missing_letters_are_an_error(spark):
    """A JVM without ICU doesn't pass for one that knows no look-alikes, and neither does a thread without an active session."""
    class Broken:
        def __getattr__(self, name):
            raise TypeError("'JavaPackage' object is not callable")

    class Session:
        _jvm = Broken()

    with pytest.raises(RuntimeError, match="ICU"):
        L._tables_of(Session())
    made = []
    df = spark.createDataFrame([("ᎪᏴ",)], "value string")
    thread = threading.Thread(target=lambda: made.extend(r["value_canonical"] for r in L.with_canonical(df, ["value"]).collect()))
    thread.start()
    thread.join()
    assert made == ["AB"]


def test_usual_characters_need_no_table():
    import re

    spans = [tuple(int(x, 16) for x in m) for m in re.findall(r"\\x\{([0-9A-F]+)\}-\\x\{([0-9A-F]+)\}", L.UNUSUAL)]
    inside = lambda c: any(a <= ord(c) <= b for a, b in spans) or ord(c) in (0x1A0, 0x1A1, 0x1AF, 0x1B0)
    assert not [c for c in L.translation()[0] if inside(c)]
    removed = [int(x, 16) for m in re.findall(r"\\x\{([0-9A-F]+)\}", L.INVISIBLE + L.BLANKS) for x in [m]]
    assert not [c for c in removed if inside(chr(c))]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40))
def test_form_is_stable(text):
    text = text.replace("\x00", "")
    once = canonical([text])[0]
    assert canonical([once])[0] == once


def test_pairs_against_brute_force(spark, rows):
    values = [("n", v) for v in ALIKE + OTHER + [PLAIN, None]] + [("t", v) for v in ALIKE[:3]] + [("t", "x" * 60_000), ("t", "х" * 60_000)]
    data = [(f, i, v, "clash") for i, (f, v) in enumerate(values)]
    df = spark.createDataFrame(data, "field_name string, id bigint, value string, value_form string")
    forms = canonical([v or "" for _, v in values])
    want = sorted(
        ((f, i, j) for (f, i, a, _), (g, j, b, _) in itertools.combinations(data, 2) if f == g and a and b and a != b and forms[i] == forms[j]), key=repr
    )
    assert rows(L.lookalike_pairs(df)) == want and len(want) > 30
    classes = {(r["field_name"], r["id"]): r["class_id"] for r in L.lookalike_classes(df).collect()}
    assert set(classes) == {(f, i) for f, *ids in want for i in ids} and all(classes[f, a] == classes[f, b] <= a for f, a, b in want)
    assert L.lookalike_pairs(df.limit(0)).collect() == [] == L.lookalike_classes(df.limit(0)).collect()


def test_many_copies_of_one_spelling(spark):
    """Equal copies never meet: 20,000 of one spelling beside two odd ones."""
    rows = spark.range(20_000).selectExpr("'n' AS field_name", "id", "'1/2020/TT-ABC' AS value").unionByName(spark.createDataFrame([("n", 50_000, "１/2020/TT-ABC"), ("n", 50_001, "1/2020/TT\u2011ABC")], "field_name string, id bigint, value string"))
    assert L.lookalike_pairs(rows).count() == 40_001


def test_other_columns_pass(spark):
    df = spark.createDataFrame([("Ａ", "old", 1), (None, "old", 2)], "value string, value_canonical string, n int")
    assert sorted((r["n"], r["value_canonical"]) for r in L.with_canonical(df, ["value"]).collect()) == [(1, "A"), (2, None)]
