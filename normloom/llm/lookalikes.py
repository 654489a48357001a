"""Visually identical text with different characters, brought to one form.

Method: DuckDB inside Arrow partitions. One embedded SQL expression per value: invisible and blank-like characters by
regular expressions, compatibility forms of several characters (ligatures, Roman numerals, squared units) by a lookup per character, look-alikes and
compatibility forms of one character by translate, then nfc_normalize, so that a look-alike base letter composes with the
combining accents that follow it. The tables come by rule from public data: the Unicode character data of Python and the confusables of
the ICU library that Spark brings along; a short list adds what those leave out.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from normloom.plans.session import Scratch, spread

#: Letters of other alphabets that look like a Latin letter or sign, then what they look like. They come before the rule.
LOOKALIKES = (
    # Greek
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳν"
    # Cyrillic
    "АВЕЅІЈКМНОРСТХҮасеорхуѕіјһԁԛԝӏ"
    # Armenian, Latin eth and African D, script g
    "ՕօÐƉɡ"
    # hyphens, slashes, stops and colons
    "‐‑⁃−⁄∕⧸․꞉∶"
)
LOOK_LIKE = "ABEZHIKMNOPTYXocjv" "ABESIJKMHOPCTXYaceopxysijhdqwl" "OoĐĐg" "----///.::"
#: Classes of regular expressions: characters of no width, and blanks other than the plain one.
INVISIBLE = r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{E0000}-\x{E007F}\x{E0100}-\x{E01EF}]"
BLANKS = r"[\t\n\r\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: A character outside the plain Latin and Vietnamese ranges: only values with one need more than composed accents.
UNUSUAL = r"[^\x{20}-\x{7E}\x{C0}-\x{CF}\x{D1}-\x{131}\x{1A0}\x{1A1}\x{1AF}\x{1B0}\x{300}-\x{34E}\x{350}-\x{36F}\x{1EA0}-\x{1EF9}]"


#: Compatibility forms that a reader can't tell from the plain characters; raised, lowered, circled, turned and broken ones differ visibly.
PLAIN_FORMS = ("<wide>", "<narrow>", "<font>", "<compat>", "<square>", "<initial>", "<medial>", "<final>", "<isolated>")


@cache
def _confusables(session: SparkSession) -> dict[str, str]:
    """Letters with case of other alphabets and the basic Latin letter of the same case that they look like, from ICU's skeletons: two strings look alike if
    their skeletons are equal. A JVM without ICU is an error, since without these letters equal-looking values would differ."""
    others = [chr(c) for c in range(0x370, 0x1E944) if unicodedata.category(chr(c)) in ("Lu", "Ll") and not unicodedata.name(chr(c), "").startswith(("LATIN", "MATHEMATICAL")) and not unicodedata.decomposition(chr(c))]
    latin = [chr(c) for c in range(ord("A"), ord("z") + 1) if chr(c).isalpha()]
    try:
        checker = session._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()  # type: ignore[attr-defined]
        shape = lambda letters: checker.getSkeleton("\n".join(letters)).split("\n")
        shapes, of_others = shape(latin), shape(others)
    except Exception as e:
        raise RuntimeError("no look-alike letters: Spark's JVM does not answer with the confusables of the ICU library (com.ibm.icu)") from e
    shown = {(shape_, unicodedata.category(x)): x for x, shape_ in zip(latin, shapes, strict=True)}
    found = {x: shown.get((shape_, unicodedata.category(x))) for x, shape_ in zip(others, of_others, strict=True)}
    return {x: y for x, y in found.items() if y}


def _tables(session: SparkSession | None = None) -> tuple[dict[str, str], dict[str, str]]:
    return _tables_of(session or SparkSession.getActiveSession())


@cache
def _tables_of(session: SparkSession | None) -> tuple[dict[str, str], dict[str, str]]:
    """Characters to one character, and characters to several. Only where Spark doesn't run at all are they without ICU's letters."""
    bases = (_confusables(session) if session is not None else {}) | dict(zip(LOOKALIKES, LOOK_LIKE, strict=True))
    one, several = dict(bases), {}
    for code in range(0xA0, 0x1FBFA):
        ch = chr(code)
        parts = unicodedata.decomposition(ch).split()
        if 0xD800 <= code < 0xE000 or not parts or ch in one:
            continue
        if parts[0] in PLAIN_FORMS:
            plain = unicodedata.normalize("NFKC", ch)
        elif parts[0][0] != "<":
            base, *marks = unicodedata.normalize("NFD", ch)
            plain = unicodedata.normalize("NFC", bases.get(base, base) + "".join(marks)) if base in bases else ch
        else:
            continue
        if plain == ch or plain[0].isspace():
            continue
        plain = "".join(bases.get(c, c) for c in plain)
        (one if len(plain) == 1 else several)[ch] = plain
    return one, several


def translation(session: SparkSession | None = None) -> tuple[str, str]:
    """(from, to) for translate: the look-alikes, every character whose compatibility form is one character, and accented letters of other
    alphabets over a look-alike base."""
    one, _ = _tables(session)
    return "".join(one), "".join(one.values())


def canonical_sql(column: str, session: SparkSession | None = None) -> str:
    """The embedded expression for one text column; null stays null. translate builds its table for every value, so it is spared the
    values that can't change by it."""
    quoted = lambda s: s.replace("'", "''")
    (source, target), (_, several) = map(quoted, translation(session)), _tables(session)
    text = f"regexp_replace({column}, '{INVISIBLE}', '', 'g')"
    text = f"regexp_replace({text}, '{BLANKS}', ' ', 'g')"
    marks = "[" + "".join(rf"\x{{{ord(c):X}}}" for c in several) + "]"
    forms = "MAP {" + ", ".join(f"'{quoted(c)}': '{quoted(x)}'" for c, x in several.items()) + "}"
    spelt = f"array_to_string(list_transform(regexp_extract_all({text}, '(?s).'), lambda c: coalesce({forms}[c], c)), '')"
    text = f"CASE WHEN regexp_matches({column}, '{marks}') THEN {spelt} ELSE {text} END"
    return f"CASE WHEN regexp_matches({column}, '{UNUSUAL}') THEN nfc_normalize(translate({text}, '{source}', '{target}')) ELSE nfc_normalize({column}) END"


def with_canonical(df: DataFrame, columns: list[str], suffix: str = "_canonical") -> DataFrame:
    """df with one more column per text column: its consistent form.

    Full-width and other compatibility forms become plain, also where they stand for several characters (ﬁ, Ⅱ, №, ㎏, …), look-alike letters of other alphabets become Latin, invisible
    characters vanish, every blank-like character becomes one plain blank, accents are composed. What a reader can see
    stays: letter case, accents, leading zeros, separators and the number of blanks. Null stays null, empty stays
    empty; a text of invisible characters becomes empty. Other columns pass unchanged; a column that already has the
    name of an added one is replaced.
    """
    kept = [f for f in df.schema.fields if f.name not in {c + suffix for c in columns}]
    df = df.select(*[f"`{f.name}`" for f in kept])
    schema = T.StructType([*kept, *[T.StructField(c + suffix, T.StringType()) for c in columns]])
    exprs = ", ".join(f'{canonical_sql(chr(34) + c + chr(34), df.sparkSession)} AS "{c}{suffix}"' for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "256MB"})
        for batch in batches:
            texts = pa.Table.from_batches([batch]).select(columns)
            con.register("texts", texts)
            made = con.sql(f"SELECT {exprs} FROM texts").to_arrow_table()
            con.unregister("texts")
            for k, c in enumerate(columns):
                batch = batch.append_column(c + suffix, made.column(k).cast(pa.string()).combine_chunks())
            yield batch

    return spread(df).mapInArrow(run, schema)


def _spelt_differently(values: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """(group, key, value, form) of the rows whose form has several spellings. Every value passes through DuckDB once."""
    scratch = Scratch(values.sparkSession, "lookalikes")
    rows = with_canonical(values.where(F.col(value) != "").select(group, key, value), [value], "_form").withColumnRenamed(f"{value}_form", "form")
    rows = scratch.write(rows, "forms")
    several = rows.groupBy(group, "form").agg(F.min(value).alias("least"), F.max(value).alias("most")).where("least <> most").select(group, "form")
    return scratch.write(rows.join(several, [group, "form"], "left_semi"), "several")


def lookalike_pairs(values: DataFrame, group: str = "field_name", key: str = "id", value: str = "value") -> DataFrame:
    """(group, id_a, id_b), id_a < id_b: pairs of rows of one group whose values differ as strings but have the same form.

    Null and empty values are no case. The distinct spellings of a form are paired first, and only then is each pair of spellings expanded to
    the rows that have them, so equal copies never meet: the work is in proportion to the pairs asked for. lookalike_classes() gives the
    same links as one row per row.
    """
    rows = _spelt_differently(values, group, key, value)
    spelt = rows.select(group, "form", F.col(value).alias("a")).distinct()
    pairs = spelt.join(spelt.withColumnRenamed("a", "b"), [group, "form"]).where("a < b").select(group, "a", "b")
    side = lambda name, at: rows.select(group, F.col(value).alias(name), F.col(key).alias(at))
    both = pairs.join(side("a", "ka"), [group, "a"]).join(side("b", "kb"), [group, "b"]).where("ka <> kb")
    return both.select(group, F.least("ka", "kb").alias("id_a"), F.greatest("ka", "kb").alias("id_b")).distinct()


def lookalike_classes(values: DataFrame, group: str = "field_name", key: str = "id", value: str = "value") -> DataFrame:
    """(group, key, class_id, n_spellings): the rows whose value is spelt in several ways, one row each, with the smallest key of their form
    and the number of its spellings."""
    rows = _spelt_differently(values, group, key, value)
    classes = rows.groupBy(group, "form", value).agg(F.min(key).alias("k")).groupBy(group, "form").agg(F.min("k").alias("class_id"), F.count("*").alias("n_spellings"))
    return rows.join(classes, [group, "form"]).select(group, key, "class_id", "n_spellings")
