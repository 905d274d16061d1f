"""History statistics: for every index event, summaries of the earlier measurements.

Semantics (one output row per index event and test that has at least one
earlier measurement): over all measurements of the same keys and test whose
time is strictly before the index time, the ten statistics

    mean, median, max, min, range, sd (sample, 0 for one value), iqr (type-7
    quartile gap), first, last (by (time, order) ascending), count

Plan.  The obvious plan joins every index event to every earlier measurement
of its keys and groups the pairs.  That emits a quadratic number of pairs for a
busy key, so it is not used.  Instead the earlier measurements of an index
event are a *prefix* of the time-ordered measurement stream of its (keys, test)
group, and all ten statistics are prefix statistics:

1. Measurements and index events are unioned into one stream per
   (keys, test).  Index events sort before measurements at the same instant,
   which gives the strict ``<``.
2. One grouped count finds the groups above ``chunk_rows`` rows.  All other rows are hash-partitioned by (keys, test) and
   sorted; one ``mapInPandas`` pass sweeps each group in time order: group-wise cumulative sums / min / max / forward fill
   (vectorised), and a sorted list for the order statistics.
3. The large groups go through ``prefixstats``: running aggregates over chunks, and order statistics by ranks that are
   routed to value buckets, so that no task holds more than a chunk of a group and nothing is copied once per chunk.

Null keys are matched to null keys (dplyr join semantics) because grouping
treats NULL as a value; pass ``null_safe=False`` to drop null-key rows instead.
"""

from __future__ import annotations

import bisect
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortkit.functions.columns import epoch_micros
from cohortkit.operators.prefix import null_safe_join
from cohortkit.operators.prefixstats import prefix_stats
from cohortkit.session import materialize

STATS = ("mean", "median", "max", "min", "range", "sd", "iqr", "first", "last", "count")

_KIND_INDEX = 0  # sorts before a measurement at the same instant: strict "<"
_KIND_MEASURE = 1


def _type7(get, n: int, p: float) -> float:
    h = (n - 1) * p
    lo = int(h)
    a = get(lo)
    if h == lo:
        return a
    return a + (h - lo) * (get(lo + 1) - a)


def _group_quartiles(kind: np.ndarray, vals: np.ndarray):
    """Median and IQR at every query row of one group (rows in time order): a sorted list, order statistics by index."""
    med = np.full(len(kind), np.nan)
    iqr = np.full(len(kind), np.nan)
    sl: list[float] = []
    for i in range(len(kind)):
        if kind[i] == _KIND_MEASURE:
            bisect.insort(sl, vals[i])
        elif sl:
            n = len(sl)
            med[i] = _type7(sl.__getitem__, n, 0.5)
            iqr[i] = _type7(sl.__getitem__, n, 0.75) - _type7(sl.__getitem__, n, 0.25)
    return med, iqr


def _process(pdf: pd.DataFrame, ckeys, out_keys, stats) -> pd.DataFrame:
    """Sweep a frame of complete groups, each in time order."""
    g = pdf.groupby(ckeys, sort=False, dropna=False).ngroup().to_numpy()
    kind = pdf["_kind"].to_numpy()
    v = pdf["_v"].to_numpy(dtype="float64")
    is_m = kind == _KIND_MEASURE
    first = pd.Series(np.where(is_m, v, np.nan)).groupby(g).transform("first").to_numpy()
    shift = np.nan_to_num(first, nan=0.0)

    x = np.where(is_m, v - shift, 0.0)
    w = is_m.astype("float64")
    df = pd.DataFrame({"g": g, "n": w, "s1": x, "s2": x * x, "mn": np.where(is_m, v, np.inf),
                       "mx": np.where(is_m, v, -np.inf), "last": np.where(is_m, v, np.nan)})
    grp = df.groupby("g", sort=False)
    n = grp["n"].cumsum().to_numpy()
    s1 = grp["s1"].cumsum().to_numpy()
    s2 = grp["s2"].cumsum().to_numpy()
    run_min = grp["mn"].cummin().to_numpy()
    run_max = grp["mx"].cummax().to_numpy()
    last = grp["last"].ffill().to_numpy()

    q = (kind == _KIND_INDEX) & (n > 0)
    out = pdf.loc[q, list(out_keys)].reset_index(drop=True)
    nq = n[q]
    res = {
        "mean": shift[q] + s1[q] / nq,
        "max": run_max[q],
        "min": run_min[q],
        "range": run_max[q] - run_min[q],
        "sd": np.sqrt(np.maximum(np.where(nq > 1, (s2[q] - s1[q] ** 2 / nq) / np.maximum(nq - 1, 1), 0.0), 0.0)),
        "first": first[q],
        "last": last[q],
        "count": nq.astype("int64"),
    }
    if "median" in stats or "iqr" in stats:
        med = np.full(len(kind), np.nan)
        iqr = np.full(len(kind), np.nan)
        bounds = np.flatnonzero(np.diff(g)) + 1
        starts = np.concatenate([[0], bounds])
        ends = np.concatenate([bounds, [len(g)]])
        for s0, e0 in zip(starts, ends):
            med[s0:e0], iqr[s0:e0] = _group_quartiles(kind[s0:e0], v[s0:e0])
        res["median"] = med[q]
        res["iqr"] = iqr[q]
    for st in stats:
        out[st] = res[st]
    return out


def _sweep_partitions(ckeys, out_keys, stats):
    """mapInPandas body: batches arrive in sort order; a group may straddle two
    batches, so the trailing group is held back until the next batch."""
    out_cols = list(out_keys) + list(stats)

    def run(batches):
        held = None
        for pdf in batches:
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            if pdf.empty:
                continue
            same = np.ones(len(pdf), dtype=bool)  # rows equal to the last row's group key
            for k in ckeys:
                col = pdf[k]
                lv = col.iloc[-1]
                same &= (col.isna() if pd.isna(lv) else (col == lv).fillna(False)).to_numpy(dtype=bool)
            diff = np.flatnonzero(~same)
            cut = int(diff.max()) + 1 if len(diff) else 0
            held = pdf.iloc[cut:].reset_index(drop=True)
            done = pdf.iloc[:cut].reset_index(drop=True)
            if len(done):
                yield _process(done, ckeys, out_keys, stats)[out_cols]
        if held is not None and len(held):
            yield _process(held, ckeys, out_keys, stats)[out_cols]

    return run


def _no_id(t: T.DataType):
    """Id of rows that have none; not NULL for whole numbers, which pandas would turn into floats."""
    return F.lit(0).cast(t) if isinstance(t, T.IntegralType) else F.lit(None).cast(t)


def history_stats(measures: DataFrame, index: DataFrame, keys: Sequence[str], *,
                  test_col: str, time_col: str, value_col: str, order_col: str,
                  index_id: str, index_time: str, tests: Sequence[str],
                  stats: Sequence[str] = STATS, chunk_rows: int = 200_000,
                  null_safe: bool = True, num_partitions: int | None = None,
                  rows_per_task: int = 20_000) -> DataFrame:
    """Long form: (keys, index_id, test, <stats>) for index events with earlier measurements.

    ``measures`` must already be filtered (codes, QC); rows with a NULL value or
    time are ignored, as a NULL never passes the reference's QC filter.
    """
    keys = list(keys)
    stats = list(stats)
    m = (measures
         .filter(F.col(value_col).isNotNull() & F.col(time_col).isNotNull())
         .select(*keys, F.col(test_col).cast("string").alias(test_col),
                 epoch_micros(time_col).alias("_t"),
                 F.col(order_col).cast("long").alias("_ord"),
                 F.col(value_col).cast("double").alias("_v"),
                 F.lit(_KIND_MEASURE).alias("_kind"),
                 _no_id(index.schema[index_id].dataType).alias(index_id)))
    ix = (index
          .filter(F.col(index_time).isNotNull())
          .select(*keys, F.explode(F.array(*[F.lit(t) for t in tests])).alias(test_col),
                  epoch_micros(index_time).alias("_t"),
                  F.lit(0).cast("long").alias("_ord"),
                  F.lit(None).cast("double").alias("_v"),
                  F.lit(_KIND_INDEX).alias("_kind"),
                  F.col(index_id)))
    if not null_safe:
        m = m.dropna(subset=keys)
        ix = ix.dropna(subset=keys)
    stream = m.unionByName(ix)
    gkeys = keys + [test_col]

    out_keys = keys + [test_col, index_id]
    kt = {f.name: f.dataType for f in stream.schema.fields}
    fields = [T.StructField(k, kt[k]) for k in out_keys]
    fields += [T.StructField(s, T.LongType() if s == "count" else T.DoubleType()) for s in stats]
    schema = T.StructType(fields)
    # an explicit partition count: the sweep is compute-heavy per byte, so the
    # planner must not coalesce it into a few tasks
    # size check (one aggregate, partial counts map-side): if no group exceeds
    # chunk_rows every group is one chunk and needs no carry
    # whole-number keys or ids with NULLs go through pandas as text: exact at any size
    whole = [c for c in [*keys, index_id] if isinstance(kt[c], T.IntegralType)]
    sizes = (stream.groupBy(*gkeys).agg(F.count(F.lit(1)).alias("_n"), F.max(F.col(index_id).isNull()).alias("_i"))
             .agg(F.max("_n").alias("m"), F.sum("_n").alias("t"), F.max("_i").alias("_null_id"),
                  *[F.max(F.col(k).isNull()).alias(f"_null_{i}") for i, k in enumerate(keys)]).collect()[0])
    has_null = {**{k: sizes[f"_null_{i}"] for i, k in enumerate(keys)}, index_id: sizes["_null_id"]}
    as_text = [c for c in whole if has_null[c]]
    swept_schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name in as_text else f for f in schema])

    def sweep(rows: DataFrame, ckeys: list[str]) -> DataFrame:
        rows = rows.withColumns({c: F.col(c).cast("string") for c in as_text})
        out = (rows.repartition(nparts, *ckeys).sortWithinPartitions(*ckeys, "_t", "_kind", "_ord")
               .mapInPandas(_sweep_partitions(ckeys, out_keys, stats), swept_schema))
        return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])

    biggest, total = sizes["m"] or 0, sizes["t"] or 0
    # sweep tasks: ~rows_per_task rows each, at most one per shuffle partition
    cap = int(measures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nparts = num_partitions or max(1, min(cap, -(-total // rows_per_task)))
    if biggest <= chunk_rows:
        return sweep(stream, gkeys)

    # (3) the few groups above chunk_rows (one row each) by prefix statistics over many tasks, all others as before
    value = F.when(F.col("_kind") == _KIND_MEASURE, F.struct("_t", "_ord", "_v"))
    large = (stream.groupBy(*gkeys).agg(F.count(F.lit(1)).alias("_n"), F.min(value).getField("_v").alias("_first"))
             .filter(F.col("_n") > chunk_rows).select(*gkeys, "_first"))
    large = materialize(large.withColumn("_gid", F.monotonically_increasing_id()), "large-groups")
    marked = null_safe_join(stream, large, gkeys)
    small = marked.filter(F.col("_gid").isNull()).drop("_gid", "_first")
    hot = marked.filter(F.col("_gid").isNotNull() & F.col("_first").isNotNull())
    found = prefix_stats(hot.select("_gid", "_t", "_kind", "_ord", "_v", "_first", index_id), index_id, stats, chunk_rows)
    found = found.join(large.drop("_first"), "_gid").select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
    return sweep(small, gkeys).unionByName(found)


def pivot_stats(long: DataFrame, id_cols: Sequence[str], test_col: str, tests: Sequence[str],
                stats: Sequence[str] = STATS, sep: str = "_") -> DataFrame:
    """Wide form: one row per id, columns ``{stat}{sep}{test}``; absent stays NULL.

    (id, test) is unique in the long form, so each cell is a conditional
    ``max`` — a code-generated hash aggregate with partial aggregation — and the
    given test list fixes the output schema (no distinct-value discovery job).
    """
    aggs = [F.max(F.when(F.col(test_col) == F.lit(t), F.col(s))).alias(f"{s}{sep}{t}")
            for t in tests for s in stats]
    return long.groupBy(*id_cols).agg(*aggs)
