"""Joins: lookups, enrichment chains, null-safe keys, window joins, cardinality checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortkit.functions.columns import add_days, flag
from cohortkit.sources.io import broadcast_if_small


def lookup_join(df: DataFrame, dim: DataFrame, on: Mapping[str, str] | Sequence[str],
                how: str = "left", max_rows: int = 1_000_000) -> DataFrame:
    """Left join to a small dimension; keys may be named differently (``{left: right}``).

    The dimension is broadcast only after its row count is checked.
    """
    if isinstance(on, Mapping):
        dim = dim.withColumnsRenamed({r: l for l, r in on.items() if r != l})
        keys = list(on.keys())
    else:
        keys = list(on)
    return df.join(broadcast_if_small(dim, max_rows), on=keys, how=how)


def enrich(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "left",
           null_safe: bool = False, multiplicity: str = "keep", order: Sequence[str] | None = None) -> DataFrame:
    """Left equi-join on ``keys``.

    * ``null_safe``: NULL key matches NULL key (dplyr's default), via ``<=>``.
    * ``multiplicity='keep'`` keeps every match (a many-to-many join multiplies
      rows, as the reference does); ``'earliest'`` keeps one match per key of
      ``other``, the first by ``order``.
    Strategy is left to the planner (AQE picks broadcast for small sides at run
    time, else sort-merge with skew splitting).
    """
    keys = list(keys)
    if multiplicity == "earliest":
        from pyspark.sql import Window

        w = Window.partitionBy(*keys).orderBy(*(order or [c for c in other.columns if c not in keys]))
        other = other.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    if not null_safe:
        return df.join(other, on=keys, how=how)
    ren = {k: f"_r_{k}" for k in keys}
    o = other.withColumnsRenamed(ren)
    cond = [F.col(k).eqNullSafe(F.col(ren[k])) for k in keys]
    return df.join(o, on=cond, how=how).drop(*ren.values())


def semi_join(df: DataFrame, lookup: DataFrame, on: Sequence[str] | Mapping[str, str]) -> DataFrame:
    """``IN (SELECT ...)``: keep rows of ``df`` whose key occurs in ``lookup``."""
    if isinstance(on, Mapping):
        lookup = lookup.select(*[F.col(r).alias(l) for l, r in on.items()])
        on = list(on.keys())
    return df.join(lookup.select(*on), on=list(on), how="left_semi")


def window_flag(t, t0, lo_days: float, hi_days: float, lo_inclusive: bool = True,
                hi_inclusive: bool = True):
    """Null-preserving flag: ``t`` within [t0+lo, t0+hi] (bounds configurable)."""
    lo = add_days(t0, lo_days)
    hi = add_days(t0, hi_days)
    tt = F.col(t).cast("timestamp") if isinstance(t, str) else t.cast("timestamp")
    c1 = (tt >= lo) if lo_inclusive else (tt > lo)
    c2 = (tt <= hi) if hi_inclusive else (tt < hi)
    return c1 & c2


def window_join(index: DataFrame, events: DataFrame, keys: Sequence[str], t: str, t0: str,
                lag_days: float, horizon_days: float, name: str = "in_window") -> DataFrame:
    """Left equi-join on keys, then flag events in ``[t0+lag, t0+horizon]`` (rows kept)."""
    out = index.join(events, on=list(keys), how="left")
    return out.withColumn(name, flag(window_flag(t, t0, lag_days, horizon_days)))


def check_cardinality(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: max matches per key on each side and the relationship (1:1, 1:n, n:1, n:m).

    Two grouped counts (map-side combined) and one join of the counts.
    """
    keys = list(keys)
    ca = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("_na"))
    cb = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nb"))
    j = ca.join(cb, on=keys, how="inner")
    r = j.agg(F.coalesce(F.max("_na"), F.lit(0)).alias("max_left_per_key"),
              F.coalesce(F.max("_nb"), F.lit(0)).alias("max_right_per_key"),
              F.count(F.lit(1)).alias("matched_keys"),
              F.coalesce(F.sum(F.col("_na") * F.col("_nb")), F.lit(0)).alias("joined_rows"))
    left_many = F.col("max_left_per_key") > 1
    right_many = F.col("max_right_per_key") > 1
    return r.withColumn("relationship",
                        F.when(left_many & right_many, "many-to-many")
                        .when(left_many, "many-to-one")
                        .when(right_many, "one-to-many")
                        .otherwise("one-to-one"))


def filter_by_threshold(df: DataFrame, key: str, value: str, thresholds, strict: bool = True) -> DataFrame:
    """Keep rows whose ``value`` is below the cutoff of their ``key`` (by name).

    ``thresholds`` is a ``{key: cutoff}`` mapping or a (key, cutoff) frame; it
    is joined by name (never by position), broadcast after a size check.  Keys
    without a cutoff are dropped by the inner join; NULL values fail.
    """
    spark = df.sparkSession
    if isinstance(thresholds, Mapping):  # size known on the driver: one row per key
        thr = F.broadcast(spark.createDataFrame([(k, float(v)) for k, v in thresholds.items()],
                                                f"{key} string, _cutoff double"))
        df = df.filter(F.col(key).isin(list(thresholds)))  # pushed to the scan as an IN filter
    else:
        thr = broadcast_if_small(thresholds.toDF(key, "_cutoff"))
    out = df.join(thr, key, "inner")
    cond = (F.col(value) < F.col("_cutoff")) if strict else (F.col(value) <= F.col("_cutoff"))
    return out.filter(cond).drop("_cutoff")
