"""Approximate nearest neighbours by a permutation index (largest inner product).

``pivots`` vectors are drawn from the data; every vector is represented by its ``prefix`` nearest pivots in
order and posted, with the pivot's rank, in those pivots' inverted files.  A query walks the files of
its own nearest pivots; for a pivot that both lists hold at ranks a and b the footrule distance with absent pivots at
the end of the list drops by 2 (prefix - max(a, b)), so the files give the ranking by footrule.  The best ``share`` of the vectors (never
fewer than ``least``) are reranked by the exact inner product in double precision.

Ranking by distance to pivots fits the inner product only for vectors of one norm, so vectors are scaled by the largest
norm and get sqrt(1 - norm^2) as a further component, queries 0: all index vectors then have norm 1, and the
products of a query with them are as before.

The index lies in blocks of vectors and queries in blocks of queries; each pair of blocks is one bounded task.
Equal vectors are one entry that keeps its k + 1 smallest ids, as later ids of the same vector cannot enter any result.

Defined cases: NULL or zero vectors, ones with NULL or non-finite components, and ones whose length is not the most
frequent one, take no part, nor do NULL ids; a query with fewer candidates gets them all; equal scores go
to the smaller id; a repeated id is one row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortkit.session import materialize

RESULT = "array<struct<neg:double,vec_id:bigint>>"


def usable(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of vectors that take part."""
    d = table.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).filter(
        F.col("id").isNotNull() & F.col("vec").isNotNull())
    fine = F.forall("vec", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    d = d.filter(fine & F.exists("vec", lambda x: x != 0))
    sizes = d.groupBy(F.size("vec").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").head(1)
    d = d.filter(F.size("vec") == (sizes[0]["n"] if sizes else 0))
    return d


def entries(vecs: DataFrame, n: int, keep: int) -> DataFrame:
    """One row per distinct vector with its ``keep`` smallest ids.

    Ids are gathered in about sqrt(n / keep) salted lists first, so that no list grows with a hot vector.
    """
    salt = F.pmod(F.xxhash64("id"), F.lit(max(16, math.isqrt(max(1, n // keep)))))

    def smallest(c):
        return F.slice(F.array_sort(F.array_distinct(c)), 1, keep)

    first = vecs.groupBy("vec", salt.alias("salt")).agg(smallest(F.collect_list("id")).alias("ids"))
    return first.groupBy("vec").agg(smallest(F.flatten(F.collect_list("ids"))).alias("ids"))


def permutations(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The ``prefix`` pivots of largest inner product of each row, nearest first (ties to the earlier pivot)."""
    near = -(x @ pivots.T)
    return np.argsort(near, axis=1, kind="stable")[:, :prefix].astype(np.int16)


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """Rows scaled by the largest norm ``top`` with the component that makes their norm 1."""
    x = x / top
    return np.hstack([x, np.sqrt(np.maximum(1 - np.einsum("ij,ij->i", x, x), 0))[:, None]])


def _matrix(col: pa.ChunkedArray, dtype) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(col.flatten()).astype(dtype).reshape(len(col), -1) if len(col) else np.zeros((0, 0), dtype)


def search_block(index: pa.Table, queries: pa.Table, prefix: int, n_pivots: int, budget: float, keep: int) -> list:
    """[(query number, [(-score, id)])]: the ``keep`` best ids of a block for each query of a block."""
    x, perm = _matrix(index.column("vec"), np.float64), _matrix(index.column("perm"), np.int64)
    q, qperm = _matrix(queries.column("qvec"), np.float64), _matrix(queries.column("qperm"), np.int64)
    ids = index.column("ids").to_pylist()
    n = len(x)
    take = min(n, max(keep, math.ceil(budget * n)))
    # inverted files: rows of each pivot and the pivot's rank in them
    flat = perm.ravel()
    order = np.argsort(flat, kind="stable")
    row = (order // perm.shape[1]).astype(np.int64)
    gain = (prefix - order % perm.shape[1]).astype(np.int32)
    at = np.searchsorted(flat[order], np.arange(n_pivots + 1))
    out = []
    for i in range(len(q)):
        near = np.zeros(n, np.int32)
        for r, p in enumerate(qperm[i].tolist()):
            s = slice(at[p], at[p + 1])
            near[row[s]] += np.minimum(gain[s], prefix - r)
        if take < n:
            # all beyond the cut and, of those on it, the earliest
            cut = np.partition(near, n - take)[n - take]
            cand = np.flatnonzero(near > cut)
            cand = np.concatenate([cand, np.flatnonzero(near == cut)[:take - len(cand)]])
        else:
            cand = np.arange(n)
        score = np.einsum("ij,j->i", x[cand], q[i])
        # the best ``keep`` vectors hold the best ``keep`` ids; equal scores at the border all stay
        if len(cand) > keep:
            border = np.partition(score, len(score) - keep)[len(score) - keep]
            ok = score >= border
            cand, score = cand[ok], score[ok]
        best = sorted((-float(s), v) for s, c in zip(score, cand.tolist()) for v in ids[c])[:keep]
        out.append(best)
    return out


def nearest(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, k: int = 20,
            pivots: int = 512, prefix: int = 64, share: float = 0.2, least: int = 2048,
            index_block: int = 8192, query_block: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of each row whose id is divisible by ``every``."""
    spark = table.sparkSession
    vecs = materialize(usable(table, id_col, vec_col), "perm-vectors")
    n = vecs.count()
    keep = k + 1  # one may be the query itself
    ent = entries(vecs, n, keep)
    ent = materialize(ent, "perm-entries")
    n_ent = ent.count()
    drawn = ent.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(pivots).collect()  # bounded: ``pivots`` vectors
    p = np.array([r["vec"] for r in drawn], np.float64)
    prefix = min(prefix, len(p))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    top = ent.agg(F.max(norm)).head()[0] or 1.0
    shared = spark.sparkContext.broadcast(lifted(p, top) if len(p) else p)

    def represent(as_query: bool):
        def run(batches):
            for b in batches:
                perm = np.zeros((0, prefix), np.int16)
                if b.num_rows:
                    x = _matrix(b.column(0), np.float64)
                    x = np.hstack([x / top, np.zeros((len(x), 1))]) if as_query else lifted(x, top)
                    perm = permutations(x, shared.value, prefix)
                offsets = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * prefix)
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.ListArray.from_arrays(offsets, pa.array(perm.ravel(), pa.int16()))],
                    [*b.schema.names, "perm"])
        return run

    def with_perm(d: DataFrame, as_query: bool, schema: str) -> DataFrame:
        return d.mapInArrow(represent(as_query), f"{schema}, perm array<short>") if n_ent else \
            d.withColumn("perm", F.array().cast("array<short>"))

    vec_type = ent.schema["vec"].dataType.simpleString()
    index = materialize(with_perm(ent, False, f"vec {vec_type}, ids array<long>"), "perm-index")
    asked = vecs.filter(F.col("id") % every == 0)
    queries = ent.join(asked.select("vec").distinct(), "vec", "left_semi").select("vec")
    queries = materialize(with_perm(queries, True, f"vec {vec_type}"), "perm-queries")
    n_q = queries.count()
    nv, nq = max(1, math.ceil(n_ent / index_block)), max(1, math.ceil(n_q / query_block))
    budget = max(share, least / max(n_ent, 1))
    left = index.select("vec", "ids", "perm", F.pmod(F.xxhash64("vec"), F.lit(nv)).alias("vb"),
                        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nq - 1).cast("long"))).alias("qb"))
    # new names: both sides of the cogroup hold the same vectors
    right = queries.select(F.col("vec").alias("qvec"), F.col("perm").alias("qperm"), F.pmod(F.xxhash64("vec", F.lit(1)), F.lit(nq)).alias("qqb"),
                           F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nv - 1).cast("long"))).alias("qvb"))
    n_pivots = len(p)

    def cell(_: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"vec": pa.array([], a.schema.field("vec").type),
                             "best": pa.array([], pa.list_(pa.struct([("neg", pa.float64()), ("vec_id", pa.int64())])))})
        found = search_block(a, b, prefix, n_pivots, budget, keep)
        best = [[{"neg": s, "vec_id": v} for s, v in f] for f in found]
        return pa.table({"vec": b.column("qvec"),
                         "best": pa.array(best, pa.list_(pa.struct([("neg", pa.float64()), ("vec_id", pa.int64())])))})

    cells = left.groupBy("vb", "qb").cogroup(right.groupBy("qvb", "qqb")).applyInArrow(
        cell, f"vec {vec_type}, best {RESULT}")
    top = cells.groupBy("vec").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, keep).alias("best"))
    ask = asked.select(F.col("id").alias("query_id"), "vec").distinct()
    mine = F.slice(F.filter("best", lambda s: s["vec_id"] != F.col("query_id")), 1, k)
    out = ask.join(top, "vec").select("query_id", F.posexplode(mine).alias("pos", "s"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("s.vec_id").alias("vec_id"),
                      (-F.col("s.neg")).alias("score"))
