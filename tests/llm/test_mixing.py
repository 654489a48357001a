import random

from normloom.llm import mixing as M

WEIGHTS = [("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 4), ("none", 0.0, 3), ("absent", 0.1, 2), (None, 0.3, 1)]


def make(spark, seed=1, n=3000):
    r = random.Random(seed)
    docs = [(i, r.choices(["big", "mid", "small", "none", "other", None], [60, 25, 6, 3, 3, 3])[0], int(r.lognormvariate(4, 1))) for i in range(n)]
    docs += [(n + 1, "big", 0), (n + 2, "mid", None), (n + 3, "big", 40_000)]
    r.shuffle(docs)
    return docs, spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint")


def test_shares_and_caps(spark, rows):
    docs, df = make(spark)
    weights = spark.createDataFrame(WEIGHTS, "source string, target_share double, max_repeats int")
    copies, shares = M.mix(df, weights)
    used = {}
    for d, s, n, c in copies.collect():
        used.setdefault(d, []).append((s, n, c))
    cap = {s: m for s, _, m in WEIGHTS}
    size = {d: (s, n) for d, s, n in docs}
    for d, v in used.items():
        assert sorted(c for _, _, c in v) == list(range(1, len(v) + 1)) and len(v) <= cap[v[0][0]] and v[0][:2] == size[d] and v[0][1] > 0
    out = {r["source"]: r for r in shares.collect()}
    total = sum(n * len(v) for d, v in used.items() for n in [size[d][1]])
    for s, share, _ in WEIGHTS[:3]:
        assert abs(out[s]["actual_share"] - share) < 0.02
        assert out[s]["tokens_out"] == sum(size[d][1] * len(v) for d, v in used.items() if size[d][0] == s) and abs(out[s]["tokens_out"] / total - out[s]["actual_share"]) < 1e-9
    assert out["none"]["copies"] == 0 and out["absent"]["copies"] == 0 and out["absent"]["n_docs"] == 0
    # systematic: a document's copies are its expected number, rounded down or up
    rates = {r["source"]: r["rate"] for r in M.plan(df, weights).collect()}
    assert all(int(rates[size[d][0]]) <= len(v) <= int(rates[size[d][0]]) + 1 for d, v in used.items())
    assert max(rates[s] / cap[s] for s in ("big", "mid", "small")) == 1.0  # as large as the caps allow


def test_same_mix_whatever_the_partitioning(spark, rows):
    docs, df = make(spark, 2, 500)
    weights = spark.createDataFrame(WEIGHTS, "source string, target_share double, max_repeats int")
    assert rows(M.mix(df, weights, seed=7)[0]) == rows(M.mix(df.repartition(7), weights, seed=7)[0])


def test_total_and_empty(spark):
    docs, df = make(spark, 3, 2000)
    weights = spark.createDataFrame(WEIGHTS, "source string, target_share double, max_repeats int")
    _, shares = M.mix(df, weights, total=20_000)
    assert abs(sum(r["tokens_out"] for r in shares.collect()) - 20_000) < 3_000
    copies, shares = M.mix(df.limit(0), weights)
    assert copies.collect() == [] and all(r["actual_share"] == 0 for r in shares.collect())
    assert M.mix(df, weights.limit(0))[0].collect() == []
