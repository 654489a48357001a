"""Encoding with a public tokenizer, and back.

Method: the tokenizers library over Arrow batches. The ids of a byte-level vocabulary stand for byte strings written in a
printable alphabet; decoding reverses that alphabet, so characters split over several tokens come out whole, and the
byte table gives each token's offsets in bytes.
"""

from __future__ import annotations

import codecs
import os
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from normloom.plans.session import spread

#: Characters of text that one call of the library gets: its encodings take a few hundred bytes a token.
CHUNK_CHARS = 200_000


def default_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    """The path of a public tokenizer file: NORMLOOM_TOKENIZERS, else the installed package, else /opt/tokenizers."""
    if folder := os.environ.get("NORMLOOM_TOKENIZERS"):
        return os.path.join(folder, name)
    try:
        import public_tokenizers

        return str(public_tokenizers.path(name))
    except ImportError:
        return f"/opt/tokenizers/{name}"


@cache
def load(path: str):
    """The tokenizer, once per Python worker; single-threaded, since Spark runs one task per core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    t.no_truncation()
    t.no_padding()
    return t


@cache
def byte_of_char() -> dict[str, int]:
    """The printable alphabet of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others for U+0100 onwards."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(others)}


@cache
def token_bytes(path: str) -> list[bytes]:
    """The byte string of each id."""
    table, vocab = byte_of_char(), load(path).get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
    return out


def decode(ids: list[int], path: str) -> str:
    """The text of the ids; bytes that form no character become U+FFFD."""
    table = token_bytes(path)
    return b"".join(table[i] for i in ids).decode("utf-8", errors="replace")


def char_offsets(ids: list[int], path: str) -> list[tuple[int, int]]:
    """(start, end) in code points of each token. A token that holds only the beginning of a character ends where it
    starts; the character belongs to the token that completes it."""
    table, reader, out, at = token_bytes(path), codecs.getincrementaldecoder("utf-8")("replace"), [], 0
    for i in ids:
        n = len(reader.decode(table[i]))
        out.append((at, at + n))
        at += n
    return out


def _chunks(texts: list[str | None]) -> Iterator[list[str]]:
    chunk, size = [], 0
    for t in texts:
        chunk.append(t or "")
        size += len(chunk[-1])
        if size >= CHUNK_CHARS:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def _map_ids(df: DataFrame, text: str, keep: list[str], name: str, kind: T.DataType, path: str, make: Callable[[list[list[int]], list[str]], pa.Array]) -> DataFrame:
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(name, kind)])
    df = spread(df.select(*keep, F.col(text).alias("_text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for batch in batches:
            at = 0
            for chunk in _chunks(batch.column(len(keep)).to_pylist()):
                ids = [e.ids for e in tokenizer.encode_batch(chunk, add_special_tokens=False)]
                part = batch.slice(at, len(chunk))
                at += len(chunk)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], make(ids, chunk)], [*keep, name])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, keep: list[str], text: str = "text", path: str | None = None, name: str = "ids") -> DataFrame:
    """The kept columns and the ids of the text, without special tokens; the strings of special tokens are ordinary text.
    A null and an empty text give an empty list. Whole texts are encoded, whatever their length."""
    return _map_ids(df, text, keep, name, T.ArrayType(T.IntegerType()), path or default_tokenizer(), lambda ids, _: pa.array(ids, pa.list_(pa.int32())))


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", path: str | None = None, name: str = "n_tokens") -> DataFrame:
    """The kept columns and the number of ids that encode() gives."""
    return _map_ids(df, text, keep, name, T.LongType(), path or default_tokenizer(), lambda ids, _: pa.array([len(x) for x in ids], pa.int64()))


def round_trip(df: DataFrame, keep: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """The kept columns and, as a struct, n_tokens, whether decoding gives the text back, whether the tokens' offsets cover
    it without gaps, and the number of tokens that end inside a character."""
    where = path or default_tokenizer()
    kind = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("same", T.BooleanType()), T.StructField("covered", T.BooleanType()), T.StructField("split_characters", T.LongType())])

    def make(ids: list[list[int]], texts: list[str]) -> pa.Array:
        rows = []
        for own, t in zip(ids, texts, strict=True):
            spans = char_offsets(own, where)
            covered = all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and (spans[-1][1] if spans else 0) == len(t)
            rows.append({"n_tokens": len(own), "same": decode(own, where) == t, "covered": covered, "split_characters": sum(a == b for a, b in spans)})
        return pa.array(rows, pa.struct([("n_tokens", pa.int64()), ("same", pa.bool_()), ("covered", pa.bool_()), ("split_characters", pa.int64())]))

    return _map_ids(df, text, keep, "trip", kind, where, make).select(*keep, "trip.*")
