"""Text functions: tokens, search queries, folding, HTML, quality, ranking."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order; no stemming, no stop words. Null gives an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


_QUERY = re.compile(r'(-?)"([^"]*)"|(-?)([^\s"]+)')


def parse_query(query: str) -> list[tuple[str, list[str]]]:
    """A web-style query as clauses ('and' | 'or' | 'not', words): words are joined by AND, 'or' between two joins them by
    OR, a leading minus excludes, quotes make a phrase."""
    out: list[tuple[str, list[str]]] = []
    joined = "and"
    for minus_q, phrase, minus_w, word in _QUERY.findall(query):
        if word.lower() == "or" and not minus_w:
            joined = "or" if out else "and"
            continue
        words = [w for w in re.findall(r"[^\W_]+", (phrase or word).lower())]
        if words:
            out.append(("not" if minus_q or minus_w else joined, words))
        joined = "and"
    return out


def query_predicate(query: str, words: Column) -> Column:
    """Whether an array of tokens matches the query. A query without words matches nothing."""

    def holds(clause: list[str]) -> Column:
        if len(clause) == 1:
            return F.array_contains(words, clause[0])
        starts = F.sequence(F.lit(0), F.size(words) - len(clause))
        here = lambda i: F.slice(words, i + 1, len(clause)) == F.array(*[F.lit(w) for w in clause])
        return (F.size(words) >= len(clause)) & F.exists(F.when(F.size(words) >= len(clause), starts).otherwise(F.array().cast("array<int>")), here)

    clauses = parse_query(query)
    groups: list[Column] = []
    for how, clause in clauses:
        if how == "or" and groups:
            groups[-1] = groups[-1] | holds(clause)
        else:
            groups.append(~holds(clause) if how == "not" else holds(clause))
    out = F.lit(bool(clauses))
    for g in groups:
        out = out & g
    return out


def query_terms(query: str) -> list[str]:
    """The distinct words that a query asks for, in order."""
    return list(dict.fromkeys(w for how, words in parse_query(query) if how != "not" for w in words))


def query_groups(query: str) -> list[list[str]]:
    """What a match has to hold, one group a requirement: the words of one group are alternatives. Excluded words are in none."""
    out: list[list[str]] = []
    for how, words in parse_query(query):
        if how == "or" and out:
            out[-1] = [*out[-1], *words]
        elif how != "not":
            out += [[w] for w in words]
    return out


def may_match(query: str, text: Column) -> Column:
    """A cheap test that every matching text passes: each requirement has one of its words somewhere in the lower-case text. It spares
    the tokens of the texts that can't match."""
    low, out = F.lower(text), F.lit(True)
    for words in query_groups(query):
        one = F.lit(False)
        for w in words:
            one = one | low.contains(w)
        out = out & one
    return out


#: Fixed value: the weight of an unlabelled word.
COVER_WEIGHT = 0.1


def cover_density(groups: list[list[str]], words: Column) -> Column:
    """Cover-density rank (Clarke, Cormack and Tudhope 2000) of an array of tokens: every shortest stretch that holds a word
    of each group adds 0.1 / (1 + the number of other words in it). No group or no such stretch: 0.

    One fold over the wanted tokens with the last place of each group: a stretch ends at every token and starts at the earliest of the last places; it is
    shortest if it starts later than the stretch before."""
    if not groups:
        return F.lit(0.0)
    wanted = sorted({w for g in groups for w in g})
    hits = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("at"))), lambda x: x["w"].isin(wanted))
    hits = F.transform(hits, lambda x, i: F.struct(x["w"].alias("w"), x["at"].alias("at"), i.alias("no")))
    none = F.lit(-1)
    start = F.struct(
        *[none.alias(f"at{g}") for g in range(len(groups))], *[none.alias(f"no{g}") for g in range(len(groups))], none.alias("before"), F.lit(0.0).alias("score"),
    )

    def step(acc: Column, x: Column) -> Column:
        at = [F.when(x["w"].isin(g), x["at"]).otherwise(acc[f"at{k}"]) for k, g in enumerate(groups)]
        no = [F.when(x["w"].isin(g), x["no"]).otherwise(acc[f"no{k}"]) for k, g in enumerate(groups)]
        low = lambda cs: F.least(*cs) if len(cs) > 1 else cs[0]
        new = low(at) > acc["before"]
        others = (x["at"] - low(at)) - (x["no"] - low(no))
        return F.struct(
            *[c.alias(f"at{k}") for k, c in enumerate(at)], *[c.alias(f"no{k}") for k, c in enumerate(no)], F.when(new, low(at)).otherwise(acc["before"]).alias("before"),
            (acc["score"] + F.when(new, F.lit(COVER_WEIGHT) / (1 + others)).otherwise(0.0)).alias("score"),
        )

    return F.coalesce(F.aggregate(hits, start, step, lambda acc: acc["score"]), F.lit(0.0))


@F.arrow_udf(T.StringType())
def nfc(text: pa.Array) -> pa.Array:
    """The composed form; null stays null. A batch that is composed already, the usual case, passes as it is. (Arrow's own
    normalisation isn't used: its NFC leaves accents apart.)"""
    values = text.to_pylist()
    if all(v is None or unicodedata.is_normalized("NFC", v) for v in values):
        return text
    return pa.array([v if v is None else unicodedata.normalize("NFC", v) for v in values], pa.string())


def fold_nfc(text: Column | str) -> Column:
    """NFC and lower case; accents stay."""
    return F.lower(nfc(text))


def _without_marks() -> tuple[str, str]:
    """(from, to) for translate: accented Latin letters and their bases, by rule from the character data; d for đ."""
    table = {"đ": "d", "Đ": "D"}
    for code in range(0xC0, 0x1F00):
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and base.isascii() and all(unicodedata.category(m) == "Mn" for m in marks):
            table[chr(code)] = base
    return "".join(table), "".join(table.values())


def fold_marks(text: Column | str) -> Column:
    """Lower case without accents, đ as d; composed and combining forms alike. Null stays null."""
    column = F.col(text) if isinstance(text, str) else text
    return F.lower(F.regexp_replace(F.translate(column, *_without_marks()), r"\p{Mn}+", ""))


class _Reader(HTMLParser):
    #: Elements on lines of their own, elements whose content is no text, and cells.
    BLOCKS = frozenset(
        "address article aside blockquote br caption dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody tfoot thead tr ul".split()
    )
    SKIPPED = frozenset("head iframe noscript object script style template".split())
    CELLS = frozenset(("td", "th"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.inside: list[str] = []  # open elements that are skipped

    def _mark(self, tag: str) -> None:
        if not self.inside and (tag in self.BLOCKS or tag in self.CELLS):
            self.out.append("\n" if tag in self.BLOCKS else " ")

    def handle_starttag(self, tag, attrs):
        if tag == "body" and self.inside[:1] == ["head"]:  # the head ends here even if nothing closes it
            self.inside.clear()
        if tag in self.SKIPPED:
            self.inside.append(tag)
        self._mark(tag)

    def handle_endtag(self, tag):
        if tag in self.inside:
            while self.inside.pop() != tag:
                pass
        else:
            self._mark(tag)

    def handle_data(self, data):
        if not self.inside:
            self.out.append(" ".join(data.split("\n")))


def html_text(html: str | None) -> str | None:
    """Text of an HTML fragment: block elements stand on lines of their own, scripts, styles, heads and embedded objects are dropped, table
    cells are spaced, runs of white space (line breaks of the source too) collapse, empty lines vanish. Null stays null."""
    if html is None:
        return None
    reader = _Reader()
    reader.feed(html)
    reader.close()
    lines = (" ".join(line.split()) for line in "".join(reader.out).split("\n"))
    return "\n".join(line for line in lines if line)


@F.pandas_udf(T.StringType())
def html_to_text(html: pd.Series) -> pd.Series:
    return html.map(html_text)


#: Characters that UTF-8 read in a one-byte code page leaves behind.
MOJIBAKE = "√∆·ªƒ∫≠‚ÄØ"
#: The bounds of the quality gate.
MAX_BAD, MAX_PRIVATE, MAX_MOJIBAKE, MAX_BLANKS, MIN_CYRILLIC, MIN_MARKS = 0.01, 0.005, 0.005, 0.40, 0.005, 0.02
LEAST_LETTERS, LEAST_MARKERS, LONG_LETTERS, PASS = 50, 8, 200, 0.6
#: The counts, each the number of matches of a class of characters.
COUNTS = {
    "letters": r"\p{L}", "wide_letters": r"[\p{L}&&[^\x00-\x7F]]", "bad": r"[\x{FFFD}\p{Cc}&&[^\n\t\r\f]]", "blanks": r"\p{IsWhite_Space}",
    "private_use": r"[\x{E000}-\x{F8FF}]", "mojibake": f"[{MOJIBAKE}]", "cyrillic": r"[\x{0400}-\x{04FF}]",
}


def with_quality(df: DataFrame, text: str, expects_marks: Column) -> DataFrame:
    """df with n_chars, the counts, confidence, ok and reason: signs of badly extracted text, what they leave of 1, and whether the
    text may be used. expects_marks adds the rule for languages written with accents: long text almost without them is suspect.

    A null or empty text has confidence 0 and is not ok. reason lists the signs of a text that isn't ok, else it is null. Columns that
    have the names of the added ones are replaced. Built-in expressions throughout, over the composed form of the text."""
    df = df.withColumn("_t", F.coalesce(nfc(text), F.lit("")))
    df = df.withColumns({"n_chars": F.length("_t").cast("bigint"), **{n: F.regexp_count("_t", F.lit(p)).cast("bigint") for n, p in COUNTS.items()}}).drop("_t")
    share = lambda n: F.col(n) / F.nullif(F.col("n_chars"), F.lit(0))
    moji = (F.col("mojibake") >= LEAST_MARKERS) & (share("mojibake") > MAX_MOJIBAKE)
    cyrillic = (F.col("cyrillic") >= LEAST_MARKERS) & (share("cyrillic") >= MIN_CYRILLIC)
    bare = expects_marks & (F.col("letters") >= LONG_LETTERS) & (F.col("wide_letters") / F.nullif(F.col("letters"), F.lit(0)) < MIN_MARKS)
    # name, when, penalty, whether it alone rejects the text
    signs = (
        ("unreadable characters", share("bad") > MAX_BAD, 5 * share("bad"), False),
        ("too few letters", F.col("letters") < LEAST_LETTERS, F.lit(0.3), True),
        ("too many blanks", share("blanks") > MAX_BLANKS, F.lit(0.3), False),
        ("private-use characters", share("private_use") > MAX_PRIVATE, F.lit(0.5), True),
        ("mis-decoded (mojibake)", moji, F.lit(0.7), True),
        ("other script (Cyrillic mojibake)", cyrillic, F.lit(0.7), True),
        ("hardly any accents", bare, F.lit(0.5), False),
    )
    empty, confidence, hard = F.col("n_chars") == 0, F.lit(1.0), share("bad") >= MAX_BAD
    for _, when, penalty, alone in signs:
        confidence = confidence - F.when(when, penalty).otherwise(0.0)
        hard = hard | when if alone else hard
    df = df.withColumn("confidence", F.when(empty, 0.0).otherwise(F.greatest(F.least(confidence, F.lit(1.0)), F.lit(0.0))))
    df = df.withColumn("ok", ~empty & (F.col("confidence") >= PASS) & ~F.coalesce(hard, F.lit(True)))
    named = F.array_join(F.array_compact(F.array(*[F.when(when, F.lit(name)) for name, when, _, _ in signs])), "; ")
    return df.withColumn("reason", F.when(empty, "empty text").when(~F.col("ok"), F.coalesce(F.nullif(named, F.lit("")), F.lit("low confidence"))))


_FNV, _PRIME = 0xCBF29CE484222325, 0x100000001B3


def _seed(token: str) -> int:
    h = _FNV
    for b in token.encode():
        h = ((h ^ b) * _PRIME) & 0xFFFFFFFFFFFFFFFF
    return h or 1


def token_vector(token: str, dimensions: int) -> np.ndarray:
    """A fixed positive unit vector per token: an xorshift stream (13, 7, 17) seeded by its FNV-1a hash."""
    x, out = _seed(token), np.empty(dimensions)
    for i in range(dimensions):
        x ^= (x << 13) & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 7
        x ^= (x << 17) & 0xFFFFFFFFFFFFFFFF
        out[i] = (x >> 11) / 2**53
    return (out / np.linalg.norm(out)).astype(np.float32)


def embedder(dimensions: int = 64):
    """A deterministic offline embedding as an iterator pandas UDF: the normalised sum of the tokens' vectors; a text without
    tokens is one token; null stays null. Token vectors are remembered per worker."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, np.ndarray] = {}

        def one(text):
            if text is None:
                return None
            words = re.findall(r"[^\W_]+", text.lower()) or [text]
            total = np.zeros(dimensions)
            for w in words:
                if w not in known:
                    if len(known) > 50_000:
                        known.clear()
                    known[w] = token_vector(w, dimensions)
                total += known[w]
            norm = math.sqrt(float(total @ total))
            return (total / norm if norm else total).astype(np.float32)

        for texts in batches:
            yield texts.map(one)

    return embed


#: Fixed value: what a number that is a signal of its own holds.
SIGNAL_NUMBER = "nhnn"


def _plain_terms(terms: list[str]) -> list[str]:
    return [unicodedata.normalize("NFC", t).lower() for t in terms]


def _found_terms(number: Column, near: Column, wide: Column, asked: list[list[str]], shown: list[list[str]]) -> Column:
    """The shown terms whose asked form is held: strong ones by wide, titled ones by near, weak ones by near beside a signal."""
    strong, titled, weak, signals = asked
    signal = number.contains(SIGNAL_NUMBER)
    for t in signals:
        signal = signal | near.contains(t)
    pick = lambda hay, a, b, also=None: [F.when(hay.contains(x) if also is None else also & hay.contains(x), F.lit(y)) for x, y in zip(a, b, strict=True) if x]
    listed = pick(wide, strong, shown[0]) + pick(near, titled, shown[1]) + pick(near, weak, shown[2], signal)
    return F.array_compact(F.array(*listed)) if listed else F.array().cast("array<string>")


def scope_terms(number: Column, title: Column, abstract: Column, strong: list[str], strong_title: list[str], weak: list[str], signals: list[str]) -> Column:
    """The vocabulary terms that a document matches: strong ones in number, title or abstract; strong_title ones in number or
    title; weak ones in number or title, only with a signal word in number or title or 'nhnn' in the number. Compared in composed lower case,
    with accents; the parts stand on lines of their own, so no term is found across the end of one. Nulls count as empty."""
    plain = lambda c: F.coalesce(fold_nfc(c), F.lit(""))
    no = plain(number)
    near = F.concat(no, F.lit("\n"), plain(title))
    wide = F.when(plain(abstract) != "", F.concat(near, F.lit("\n"), plain(abstract))).otherwise(near)
    terms = [_plain_terms(t) for t in (strong, strong_title, weak, signals)]
    return _found_terms(no, near, wide, terms, terms)


def scope_query_terms(query: Column, strong: list[str], strong_title: list[str], weak: list[str], signals: list[str]) -> Column:
    """The terms that a question matches: as scope_terms over the question, and where that finds none and the question is written without
    any accents, with question and terms both without them. The terms are given as they are in the vocabulary."""
    strict = scope_terms(F.lit(""), query, query, strong, strong_title, weak, signals)
    shown = [_plain_terms(t) for t in (strong, strong_title, weak, signals)]
    bare = [["".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn").replace("đ", "d") for t in ts] for ts in shown]
    hay = F.coalesce(fold_marks(query), F.lit(""))
    loose = _found_terms(hay, hay, hay, bare, shown)
    return F.when((F.size(strict) > 0) | (hay != F.coalesce(fold_nfc(query), F.lit(""))), strict).otherwise(loose)


SCOPE_CLASSES = ("strong", "strong_title", "weak", "signal")


def scope_vocabulary(terms: list[tuple[str, str]]) -> list[list[str]]:
    """(text, class) rows as the four lists of scope_terms; rows of another class are ignored."""
    return [[t for t, c in terms if c == k] for k in SCOPE_CLASSES]
