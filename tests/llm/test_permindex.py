import numpy as np
from pyspark.sql import functions as F

from cohortkit.llm import permindex
from tests.llm.conftest import SMALL


def _exact(ids, x, k=20):
    out = {}
    for i in sorted(set(ids)):
        if i % 20 == 0:
            q = x[ids.index(i)]
            s = sorted((-float(np.einsum("j,j->", x[n], q)), j) for n, j in enumerate(ids) if j != i)
            out[i] = s[:k]
    return out


def test_recall_scores_and_odd_vectors(spark):
    rows = [(int(r[0]), [float(v) for v in r[1]]) for r in spark.read.parquet(
        f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()]
    n = max(r[0] for r in rows) + 1
    hot = rows[3][1]
    rows += [(n + i, hot) for i in range(60)]  # one vector many times
    odd = [(n + 100, None), (n + 120, [0.0] * len(hot)), (n + 140, [float("nan")] + hot[1:]), (n + 160, [None] + hot[1:]),
           (n + 180, [float("inf")] + hot[1:]), (n + 200, hot[:-1]), (None, hot)]
    d = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    ids, x = [r[0] for r in rows], np.array([r[1] for r in rows], np.float32).astype(np.float64)
    want = _exact(ids, x)
    for kw in ({}, {"index_block": 100, "query_block": 7, "least": 150, "share": 0.1}):
        got = {}
        for r in permindex.nearest(d, **kw).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
            assert r["rank"] == len(got[r["query_id"]])
        assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
        hits = 0
        for q, v in got.items():
            assert v == sorted(v)
            for s, j in v:
                assert abs(-s - float(x[ids.index(j)] @ x[ids.index(q)])) < 1e-12
            hits += len({j for _, j in v} & {j for _, j in want[q]})
        assert hits >= 0.9 * 20 * len(want)
    assert permindex.nearest(d.limit(0)).count() == 0
    assert permindex.nearest(d.filter(F.col("vec_id") < 3)).count() == 2


def test_recall_of_the_shipped_share_with_varying_norms(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(26_000, 64))
    x *= (np.exp(0.3 * rng.normal(size=(len(x), 1))) / np.linalg.norm(x, axis=1)[:, None])
    x = x.astype(np.float32)
    d = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    given = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    y = np.array([r[0] for r in given.select("embedding").orderBy("vec_id").collect()], np.float32)
    y_ids = np.array([r[0] for r in given.select("vec_id").orderBy("vec_id").collect()])
    for table, ids, m, every in ((d, np.arange(len(x)), x.astype(np.float64), 260), (given, y_ids, y.astype(np.float64), 20)):
        got = {}
        for r in permindex.nearest(table, every=every, least=0).collect():  # the share alone, as in a large table
            got.setdefault(r["query_id"], set()).add(r["vec_id"])
        hits = 0
        for q, found in got.items():
            s = m @ m[np.searchsorted(ids, q)]
            s[ids == q] = -np.inf
            hits += len(found & set(ids[np.argsort(-s)[:20]].tolist()))
        assert len(got) == sum(ids % every == 0) and hits >= 0.94 * 20 * len(got), hits / (20 * len(got))
