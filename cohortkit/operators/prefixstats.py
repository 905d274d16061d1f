"""Prefix statistics of large groups: for an index row, statistics of the values before it in its group's time order.

Rows get a unique position in order of (group, time), cut into chunks (``ordered.positions``) of about ``chunk_rows`` rows, or
``GRID`` times the square root of the number of rows if that is more: chunks times buckets, the grid below, then stay below a
sixteenth of the rows, and a task's memory grows as the square root of the rows.

* Count, mean, sd, extremes and last value are running aggregates inside a chunk plus those of the group's earlier chunks.
* Order statistics are prefix selections on a grid of time chunks and value buckets (chunks of the order (group, value)).  The grid
  holds how many values of a bucket lie in earlier chunks; a chunk's task adds the values before the index row in its own
  chunk, finds the bucket that holds each wanted rank, and sends (row, rank inside the bucket) there.  A bucket's task finds the
  value of that rank among the bucket's values before the row.  A bucket that many ranks are sent to is read by several tasks, each
  with a part of them, so the rows read grow with rows and ranks, not with chunks, and a task holds a chunk or a bucket.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortkit.operators.ordered import positions
from cohortkit.session import materialize

PROBS = (0.25, 0.5, 0.75)
GRID = 4


def _find(code: np.ndarray, base: np.ndarray, before: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query the code of the k-th smallest (from 0) among ``base[c]`` copies of every code c and the first ``before``
    entries of ``code``, and its rank among the copies of that code.

    All queries descend together, a bit of the code a step: ``code`` is kept in order of the bits above, each node a run of it
    in the order of entry, so a query's entries are the run's first ones.
    """
    bits = max(1, int(len(base) - 1).bit_length())
    copies = np.zeros((1 << bits) + 1, np.int64)
    copies[1:len(base) + 1] = base
    copies = np.cumsum(copies)
    start, stop, low, k = np.zeros(len(k), np.int64), before.astype(np.int64), np.zeros(len(k), np.int64), k.astype(np.int64)
    for bit in range(bits - 1, -1, -1):
        one = (code >> bit) & 1
        zeros = np.concatenate([[0], np.cumsum(1 - one)])
        zs, ze = zeros[start], zeros[stop]
        left = ze - zs + copies[low + (1 << bit)] - copies[low]
        right = k >= left
        k = np.where(right, k - left, k)
        start = np.where(right, zeros[-1] + start - zs, zs)
        stop = np.where(right, zeros[-1] + stop - ze, ze)
        low = low + (right.astype(np.int64) << bit)
        code = np.concatenate([code[one == 0], code[one == 1]])
    return low, k


def _route(pdf: pd.DataFrame) -> pd.DataFrame:
    """One (group, chunk): grid rows (kind 0: bucket, values in earlier chunks), values (1: position, bucket) and index rows
    (2: position, number of values before).  For each wanted rank: the bucket that holds it and the rank inside.  Both ranks
    around a probability's place are one row (k, k2) if they lie in one bucket, else two, with -1 for the other."""
    kind, pos, n = (pdf[c].to_numpy() for c in ("kind", "pos", "n"))
    bucket = pdf["_bucket"].to_numpy()
    o = np.argsort(bucket[kind == 0])
    buckets, base = bucket[kind == 0][o], n[kind == 0][o]
    o = np.argsort(pos[kind == 1])
    at, part = pos[kind == 1][o], np.searchsorted(buckets, bucket[kind == 1][o])
    p, total = pos[kind == 2], n[kind == 2]
    before = np.searchsorted(at, p)
    rows = []
    for which, prob in enumerate(PROBS):
        h = (total - 1) * prob
        (b1, k1), (b2, k2) = (_find(part, base, before, f(h).astype(np.int64)) for f in (np.floor, np.ceil))
        apart = b1 != b2
        rows.append((b1, p, which, k1, np.where(apart, -1, k2)))
        rows.append((b2[apart], p[apart], which, np.full(apart.sum(), -1), k2[apart]))
    return pd.concat([pd.DataFrame({"_gid": pdf["_gid"].iloc[0] if len(pdf) else 0, "_bucket": buckets[b], "pos": q, "which": w,
                                    "k": x, "k2": y}) for b, q, w, x, y in rows], ignore_index=True)


def _select(pdf: pd.DataFrame) -> pd.DataFrame:
    """One part of a (group, bucket): values (kind 1: position, place k in value order, value) and sent ranks (kind 2: position of
    the index row, which, ranks k and k2).  For each rank its value among the values at smaller positions; none for -1."""
    m, q = pdf[pdf["kind"] == 1], pdf[pdf["kind"] == 2]
    m = m.sort_values("k")
    by_value, value = m["pos"].to_numpy(), m["_v"].to_numpy()
    o = np.argsort(by_value)  # place in value order of the values in time order
    before = np.searchsorted(by_value[o], q["pos"].to_numpy())
    out = {"pos": q["pos"].to_numpy(), "which": q["which"].to_numpy()}
    for x, k in (("x", "k"), ("y", "k2")):
        rank = q[k].to_numpy()
        has = np.flatnonzero(rank >= 0)
        out[x] = np.full(len(q), np.nan)
        out[x][has] = value[_find(o, np.zeros(len(m), np.int64), before[has], rank[has])[0]]
    return pd.DataFrame(out)


def _quartiles(rows: DataFrame, asked: DataFrame, chunk_rows: int) -> DataFrame:
    """(_pos, q25, q50, q75) of index rows ``asked`` (_gid, _chunk, _pos, _count) among ``rows``' values before them."""
    m = rows.filter(F.col("_v").isNotNull()).select("_gid", "_chunk", "_pos", "_v")
    m = positions(m, ["_gid", "_v", "_pos"], max(1, -(-m.count() // chunk_rows)), "_vpos", "_bucket")
    have = m.groupBy("_gid", "_chunk", "_bucket").agg(F.count(F.lit(1)).alias("n"))
    # every bucket of a group at every chunk of it that asks; at most chunks times buckets of the group
    cells = asked.select("_gid", "_chunk").distinct().withColumn("asks", F.lit(True))
    cells = cells.unionByName(have.select("_gid", "_chunk").distinct().withColumn("asks", F.lit(False)))
    cells = cells.groupBy("_gid", "_chunk").agg(F.max("asks").alias("asks"))
    grid = cells.join(have.select("_gid", "_bucket").distinct(), "_gid").join(have, ["_gid", "_chunk", "_bucket"], "left")
    earlier = Window.partitionBy("_gid", "_bucket").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("n", F.coalesce(F.sum("n").over(earlier), F.lit(0))).filter("asks")
    none = F.lit(0).cast("long")
    pieces = grid.select("_gid", "_chunk", F.lit(0).alias("kind"), none.alias("pos"), "_bucket", "n").unionByName(
        m.join(cells.filter("asks").select("_gid", "_chunk"), ["_gid", "_chunk"])
        .select("_gid", "_chunk", F.lit(1).alias("kind"), F.col("_pos").alias("pos"), "_bucket", none.alias("n"))).unionByName(
        asked.select("_gid", "_chunk", F.lit(2).alias("kind"), F.col("_pos").alias("pos"), none.alias("_bucket"),
                     F.col("_count").alias("n")))
    sent = materialize(pieces.groupBy("_gid", "_chunk").applyInPandas(
        _route, "_gid long, _bucket long, pos long, which int, k long, k2 long"), "ranks")
    parts = sent.groupBy("_gid", "_bucket").agg(F.ceil(F.count(F.lit(1)) / F.lit(chunk_rows)).cast("int").alias("parts"))
    ranks = sent.join(parts, ["_gid", "_bucket"]).withColumn("part", F.pmod(F.xxhash64("pos"), F.col("parts")).cast("int"))
    values = m.join(parts, ["_gid", "_bucket"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    both = values.select("_gid", "_bucket", "part", F.lit(1).alias("kind"), F.col("_pos").alias("pos"), F.lit(0).alias("which"),
                         F.col("_vpos").alias("k"), none.alias("k2"), "_v").unionByName(
        ranks.select("_gid", "_bucket", "part", F.lit(2).alias("kind"), "pos", "which", "k", "k2",
                     F.lit(0.0).alias("_v")))
    found = both.groupBy("_gid", "_bucket", "part").applyInPandas(_select, "pos long, which int, x double, y double")
    wide = found.groupBy(F.col("pos").alias("_pos")).agg(*[F.max(F.when(F.col("which") == i, F.col(c))).alias(f"{c}{i}")
                                                           for i in range(len(PROBS)) for c in ("x", "y")])
    at = asked.select("_pos", "_count").join(wide, "_pos")
    q = []
    for i, p in enumerate(PROBS):
        h = (F.col("_count") - 1) * F.lit(p)
        a, b = F.col(f"x{i}"), F.col(f"y{i}")
        q.append(F.when(a == b, a).otherwise(a + (h - F.floor(h)) * (b - a)).alias(f"q{int(p * 100)}"))
    return at.select("_pos", *q)


def prefix_stats(stream: DataFrame, id_col: str, stats: Sequence[str], chunk_rows: int) -> DataFrame:
    """(_gid, id_col, stats) for the index rows of ``stream`` with a value before them.

    stream: _gid, _t, _kind (index rows sort before values of the same time), _ord, _v (NULL in index rows), _first (the group's
    first value, by which sums are shifted) and ``id_col``.
    """
    size = stream.count()
    chunk_rows = max(chunk_rows, GRID * math.isqrt(size))
    rows = positions(stream, ["_gid", "_t", "_kind", "_ord", "_v"], max(1, -(-size // chunk_rows)))
    shifted = F.col("_v") - F.col("_first")
    aggs = {"_count": F.count("_v"), "_s1": F.sum(shifted), "_s2": F.sum(shifted * shifted), "_min": F.min("_v"), "_max": F.max("_v")}
    here = Window.partitionBy("_gid", "_chunk").orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chunk = rows.groupBy("_gid", "_chunk").agg(
        *[v.alias(k) for k, v in aggs.items()], F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("_pos"))).alias("_last"))
    before = Window.partitionBy("_gid").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunk = chunk.select("_gid", "_chunk", *[F.sum(c).over(before).alias(f"_b{c}") for c in ("_count", "_s1", "_s2")],
                         F.min("_min").over(before).alias("_b_min"), F.max("_max").over(before).alias("_b_max"),
                         F.last("_last", ignorenulls=True).over(before).alias("_b_last"))
    run = rows.withColumns({k: v.over(here) for k, v in aggs.items()}).withColumn(
        "_last", F.last("_v", ignorenulls=True).over(here))
    run = run.filter(F.col("_v").isNull()).join(chunk, ["_gid", "_chunk"])
    zero = F.lit(0)
    run = run.withColumns({c: F.coalesce(c, zero) + F.coalesce(f"_b{c}", zero) for c in ("_count", "_s1", "_s2")})
    run = run.withColumns({"_min": F.least("_min", "_b_min"), "_max": F.greatest("_max", "_b_max"),
                           "_last": F.coalesce("_last", "_b_last")}).filter("_count > 0")
    n, s1, s2 = F.col("_count"), F.col("_s1"), F.col("_s2")
    exprs = {
        "mean": F.col("_first") + s1 / n, "max": F.col("_max"), "min": F.col("_min"), "range": F.col("_max") - F.col("_min"),
        "sd": F.when(n > 1, F.sqrt(F.greatest((s2 - s1 * s1 / n) / (n - 1), F.lit(0.0)))).otherwise(0.0),
        "first": F.col("_first"), "last": F.col("_last"), "count": n,
    }
    if {"median", "iqr"} & set(stats):
        run = materialize(run, "prefix-rows")
        run = run.join(_quartiles(rows, run.select("_gid", "_chunk", "_pos", "_count"), chunk_rows), "_pos")
        exprs |= {"median": F.col("q50"), "iqr": F.col("q75") - F.col("q25")}
    return run.select("_gid", id_col, *[exprs[s].alias(s) for s in stats])
