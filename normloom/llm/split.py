"""Splitting oversized texts at natural boundaries.

Method: recursive bisection. A stretch that is too long is cut at the strongest boundary near its midpoint, and both halves
are treated the same until each is within the limit minus the overlap; then each piece but the first gets the overlap from
the text before it. The class of a text follows from its cuts: it is forced if a stretch without a boundary had to be cut though it is
longer than the limit itself.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normloom.plans.session import spread

#: A boundary ends right after a line break, or after white space that follows one of . ; : ! ?
BREAK = re.compile(r"(?:\r\n|[\n\r\v\f\x85\u2028\u2029])|(?<=[.;:!?])\s")
BLANK = re.compile(r"\s+")
LINE = "\n\r\v\f\x85\u2028\u2029"


def boundaries(text: str) -> tuple[list[int], list[int], list[int]]:
    """Cut positions by strength: after an empty line, after a line break, after the end of a sentence or clause. Ascending."""
    paragraph, line, clause = [], [], []
    for m in BREAK.finditer(text):
        at = m.end()
        if not 0 < at < len(text):
            continue
        if text[at - 1] in LINE:
            (paragraph if m.start() and text[m.start() - 1] in LINE else line).append(at)
        else:
            clause.append(at)
    return paragraph, line, clause


def _near(cuts: list[int], low: int, high: int, middle: float) -> int | None:
    """The cut in [low, high] nearest to the middle; the earlier of two at equal distance."""
    i, j = bisect_left(cuts, low), bisect_right(cuts, high)
    if i == j:
        return None
    k = bisect_left(cuts, middle, i, j)
    return min(cuts[max(i, k - 1) : min(j, k + 1)], key=lambda c: (abs(c - middle), c))


def _cut(text: str, start: int, end: int, levels: tuple[list[int], ...], blanks: list[int]) -> tuple[int, bool]:
    """Where to cut [start, end) and whether at a natural boundary."""
    size, middle = end - start, (start + end) / 2
    for share in (0.25, 0.5):  # the middle half first, then anywhere
        low, high = max(start + 1, int(middle - share * size)), min(end - 1, int(middle + share * size))
        for cuts in levels:
            if (at := _near(cuts, low, high, middle)) is not None:
                return at, True
    low, high = max(start + 1, int(middle - 0.25 * size)), min(end - 1, int(middle + 0.25 * size))
    if (at := _near(blanks, low, high, middle)) is not None:
        return at, False
    return (start + end) // 2, False


def bisect(text: str, limit: int = 1200, overlap: int = 100) -> tuple[str, list[tuple[int, int, int, bool]]]:
    """The class of the text and its pieces in order, (start, own, end, natural) each: the piece is text[start:end], of which text[start:own] is
    overlap and natural tells whether own is a natural boundary (the first piece: True). A text within the limit is one piece.

    A stretch without boundaries is cut at white space or in its middle. That makes the text forced only if the stretch, without the boundary that
    closes it, is longer than the limit; one that is merely longer than the limit minus the overlap leaves it natural."""
    if len(text) <= limit:
        return "natural", [(0, 0, len(text), True)]
    levels = boundaries(text)
    closing = {m.end(): m.end() - m.start() for m in BREAK.finditer(text)}
    blanks = [m.end() for m in BLANK.finditer(text) if m.end() < len(text)]
    room, todo, found, forced = limit - overlap, [(0, len(text), True)], [], False
    while todo:  # a stack instead of recursion: texts may be very long
        start, end, natural = todo.pop()
        if end - start <= room:
            found.append((start, end, natural))
            continue
        at, good = _cut(text, start, end, levels, blanks)
        forced = forced or not good and end - start - closing.get(end, 0) > limit
        todo.append((at, end, good))
        todo.append((start, at, natural))
    cuts = [(max(0, start - overlap) if start else 0, start, end, natural) for start, end, natural in found]
    return "forced" if forced else "natural", cuts


def pieces(text: str, limit: int = 1200, overlap: int = 100) -> list[tuple[int, int, int, bool]]:
    """The pieces of bisect()."""
    return bisect(text, limit, overlap)[1]


PIECES = "section_id string, citation_path string, cut_class string, piece_no int, own_start int, piece_start int, piece_end int, natural_start boolean, piece string"
CLASSES = "section_id string, size int, digest string, citation_path string, cut_class string, n_pieces int"


def _long(sections: DataFrame, limit: int) -> DataFrame:
    return sections.where(F.length("text") > limit).where("id is not null").select("id", "citation_path", "text")


def split_sections(sections: DataFrame, limit: int = 1200, overlap: int = 100) -> DataFrame:
    """The pieces of every section whose text is longer than the limit, one row each: section_id, citation_path, cut_class,
    piece_no (from 1), own_start, piece_start, piece_end (code points, 0-based, end exclusive), natural_start, piece.

    Every piece is at most limit long, each but the first begins with the last overlap characters before its own start,
    and own stretches joined give the text. A section delivered twice (same id) counts once: of different copies the one
    with the longest text, then the largest MD5 of the text, then the largest path. Null, blank and short texts and null ids give no rows; a
    null path stays null.
    """
    rank = F.struct(F.length("text").alias("n"), F.md5("text").alias("d"), F.col("citation_path").alias("p"))
    once = _long(sections, limit).groupBy("id").agg(F.max_by(F.struct("citation_path", "text"), rank).alias("s")).select("id", "s.citation_path", "s.text")
    names = [c.split()[0] for c in PIECES.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: list[tuple] = []
            size = 0
            for key, path, text in frame.itertuples(index=False, name=None):
                kind, found = bisect(text, limit, overlap)
                for no, (start, own, end, natural) in enumerate(found, 1):
                    rows.append((key, path, kind, no, own, start, end, natural, text[start:end]))
                    size += end - start
                if size > 4_000_000:  # very long texts: hand over in steps
                    yield pd.DataFrame(rows, columns=names)
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=names)

    return once.mapInPandas(run, PIECES)


def section_classes(sections: DataFrame, limit: int = 1200, overlap: int = 100) -> DataFrame:
    """section_id, citation_path, cut_class and n_pieces of every section that split_sections() cuts, by the same cuts, without the pieces'
    texts: every text is cut where it is read, and only a short row per text is shuffled to keep one per section (the same one)."""
    given = _long(sections, limit).select("id", "citation_path", F.md5("text").alias("digest"), "text")
    names = [c.split()[0] for c in CLASSES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3).to_pylist()
            made = [bisect(t, limit, overlap) for t in texts]
            columns = [batch.column(0), pa.array(map(len, texts), pa.int32()), batch.column(2), batch.column(1), pa.array([k for k, _ in made], pa.string()), pa.array([len(x) for _, x in made], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names)

    rank = F.struct(F.col("size"), F.col("digest"), F.col("citation_path").alias("p"))
    best = spread(given).mapInArrow(run, CLASSES).groupBy("section_id").agg(F.max_by(F.struct("citation_path", "cut_class", "n_pieces"), rank).alias("s"))
    return best.select("section_id", "s.*")


def rebuilt(pieces_of: DataFrame, overlap: int = 100) -> DataFrame:
    """Per section of split_sections() what its pieces state together: n_chars and digest (MD5) of the own stretches joined, the longest piece, and
    whether they are numbered without gaps and each but the first begins with the overlap that ends the one before."""
    own = F.substring("piece", F.col("own_start") - F.col("piece_start") + 1, F.lit(1 << 30))
    one = pieces_of.select("section_id", F.struct("piece_no", "piece_start", "own_start", "piece_end", own.alias("own"), F.substring("piece", F.lit(1), F.col("own_start") - F.col("piece_start")).alias("lap")).alias("p"))
    one = one.groupBy("section_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    whole = F.array_join(F.transform("p", lambda p: p["own"]), "")
    joined = F.forall(F.sequence(F.lit(1), F.size("p")), lambda i: (F.element_at("p", i)["piece_no"] == i) & (F.element_at("p", i)["own_start"] == F.when(i == 1, 0).otherwise(F.get("p", i - 2)["piece_end"])))
    laps = F.forall("p", lambda p: (F.length(p["lap"]) == F.least(F.lit(overlap), p["own_start"])) & (p["lap"] == F.substring(F.col("whole"), p["piece_start"] + 1, F.length(p["lap"]))))
    one = one.withColumn("whole", whole)
    return one.select("section_id", F.length("whole").alias("n_chars"), F.md5("whole").alias("digest"), F.array_max(F.transform("p", lambda p: p["piece_end"] - p["piece_start"])).alias("longest"), (joined & laps).alias("sound"))
