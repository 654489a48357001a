"""Hybrid search: vector and lexical rankings per corpus, fused by reciprocal rank, merged over the corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normloom.functions import text as X
from normloom.functions import vectors as V
from normloom.plans.session import spread

RRF_K = 60


def fused_score(rank_v: Column, rank_l: Column) -> Column:
    """Reciprocal rank fusion (Cormack, Clarke and Büttcher 2009); a missing rank adds nothing."""
    part = lambda r: F.coalesce(F.lit(1.0) / (RRF_K + r), F.lit(0.0))
    return part(rank_v) + part(rank_l)


def lexical_index(sections: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """The postings of the sections' texts, one row per word and section: term, key, the kept columns, positions (ascending) and n_tokens.

    Written at ingest (bucketed or sorted by term), it lets lexical_top_k read the rows of a query's words instead of every text."""
    words = spread(sections.select(key, *keep, "text")).select(key, *keep, X.tokens(F.col("text")).alias("words"))
    each = words.select(key, *keep, F.size("words").alias("n_tokens"), F.posexplode("words").alias("at", "term"))
    return each.groupBy("term", key, *keep).agg(F.array_sort(F.collect_list("at")).alias("positions"), F.first("n_tokens").alias("n_tokens"))


def from_postings(postings: DataFrame, query: str, key: str, keep: list[str]) -> DataFrame:
    """key, the kept columns and words, for the sections that hold a word of the query: an array of tokens that is as long as the text
    up to the last word of the query and null at the places of all others, so that predicates and ranks read it as they read a text's."""
    asked = sorted({w for _, words in X.parse_query(query) for w in words})
    one = postings.where(F.col("term").isin(asked)).groupBy(key, *keep).agg(F.map_from_entries(F.flatten(F.collect_list(F.transform("positions", lambda at: F.struct(at, F.col("term")))))).alias("at"))
    return one.select(key, *keep, F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys("at"))), lambda i: F.col("at")[i]).alias("words"))


def lexical_top_k(sections: DataFrame, query: str, k: int, partition: str, key: str, postings: bool = False) -> DataFrame:
    """The k best matching rows of each partition with lexical and rank_l, by cover density; ties go by key.

    sections hold the texts or (postings) the rows of lexical_index. Of texts only those are cut into tokens that hold the query's words at all."""
    if postings:
        words = from_postings(sections, query, key, [partition])
    else:
        words = spread(sections.where(X.may_match(query, F.col("text")))).withColumn("words", X.tokens(F.col("text"))).drop("text")
    hit = words.where(F.coalesce(X.query_predicate(query, F.transform("words", lambda w: F.coalesce(w, F.lit("")))), F.lit(False)))
    hit = hit.withColumn("lexical", F.round(X.cover_density(X.query_groups(query), F.col("words")), 9)).drop("words")
    order = Window.partitionBy(partition).orderBy(F.desc("lexical"), key)
    return hit.withColumn("rank_l", F.row_number().over(order)).where(F.col("rank_l") <= k)


def hybrid_search(sections: DataFrame, query: str, vector: list[float] | Column, k: int = 10, where: Column | None = None, partition: str = "corpus_id", key: str = "section_id", postings: DataFrame | None = None) -> DataFrame:
    """The k best rows over all corpora: partition, key, rank_v, rank_l, score.

    sections: partition, key, text, embedding and the columns of where, which filters before either ranking; vector may be a scalar
    subquery. With postings (of lexical_index, over the same rows) no text is read; where then picks the sections by a semi join. Ranks are within
    a corpus, so the best row of every corpus scores about alike; the merge orders by score, corpus, key. k of 0 or less is 10.
    Rows without an embedding or without a match take part in the other ranking only.
    """
    k = k if k > 0 else 10
    base = sections if where is None else sections.where(where)
    near = V.top_k(base.select(partition, key, "embedding"), vector, k, partition, key).select(partition, key, "rank_v")
    if postings is None:
        hits = lexical_top_k(base.select(partition, key, "text"), query, k, partition, key)
    else:
        seen = postings if where is None else postings.join(base.select(key), key, "left_semi")
        hits = lexical_top_k(seen, query, k, partition, key, postings=True)
    hits = hits.select(partition, key, "rank_l")
    both = near.join(hits, [partition, key], "full_outer").withColumn("score", F.round(fused_score(F.col("rank_v"), F.col("rank_l")), 9))
    best = both.withColumn("place", F.row_number().over(Window.partitionBy(partition).orderBy(F.desc("score"), key))).where(F.col("place") <= k).drop("place")
    return best.orderBy(F.desc("score"), partition, key).limit(k)


def with_bodies(hits: DataFrame, sections: DataFrame, key: str = "section_id") -> DataFrame:
    """Late materialisation: the few hits are broadcast (at most k rows), and only then are the wide columns read."""
    return sections.join(F.broadcast(hits.drop("corpus_id")), key)


def vector_multi_query(items: DataFrame, queries: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """(query_id, item_id, distance, place): the k nearest items of every query.

    items: item_id, embedding; queries: query_id, embedding. Both are packed into chunks of about block rows by a hash of the
    id; every chunk of queries meets every chunk of items as one matrix product and gives k rows per query. The query set is
    stated by the caller; each pair of chunks is one small task, and only ids and distances leave it.
    """
    import numpy as np
    import pandas as pd

    def packed(df: DataFrame, key: str, name: str) -> DataFrame:
        df = df.where("embedding is not null")
        chunks = max(1, -(-df.count() // block))
        at = F.pmod(F.xxhash64(key), F.lit(chunks)).alias("chunk")
        rows = df.groupBy(at).agg(F.collect_list(F.struct(key, "embedding")).alias("rows"))
        return rows.select(F.transform("rows", lambda r: r[key]).alias(f"{name}_ids"), F.flatten(F.transform("rows", lambda r: r["embedding"])).alias(f"{name}_flat"))

    joined = packed(items, "item_id", "i").crossJoin(packed(queries, "query_id", "q"))

    def run(frames):
        for frame in frames:
            for r in frame.itertuples(index=False):
                a = np.asarray(r.i_flat, dtype=np.float64).reshape(len(r.i_ids), -1)
                q = np.asarray(r.q_flat, dtype=np.float64).reshape(len(r.q_ids), -1)
                a /= np.linalg.norm(a, axis=1, keepdims=True)
                q /= np.linalg.norm(q, axis=1, keepdims=True)
                d = np.round(1 - q @ a.T, 9)
                ids = np.asarray(r.i_ids)
                for i, qid in enumerate(r.q_ids):
                    best = np.lexsort((ids, d[i]))[:k]
                    yield pd.DataFrame({"query_id": qid, "item_id": ids[best], "distance": d[i][best]})

    kind = f"query_id {queries.schema['query_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, distance double"
    near = joined.mapInPandas(run, kind)
    return near.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "item_id"))).where(F.col("place") <= k)
