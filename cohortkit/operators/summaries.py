"""Grouped summaries (the ten statistics), counts, class balance, schema profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortkit.operators.prefix import null_safe_join

STAT_NAMES = ("mean", "median", "max", "min", "range", "sd", "iqr", "first", "last", "count")


def stat_columns(value: str, order: Sequence[str], stats: Sequence[str]) -> list:
    """Aggregate expressions for ``summarise`` (all but median and iqr): built-in, exact, partial on the map side.

    first/last are by an explicit order (struct of ``order`` columns), never by physical row order.
    """
    v = F.col(value)
    key = F.when(v.isNotNull(), F.struct(*[F.col(o) for o in order]))
    exprs = {
        "mean": F.avg(v),
        "max": F.max(v),
        "min": F.min(v),
        "range": F.max(v) - F.min(v),
        "sd": F.coalesce(F.stddev_samp(v), F.lit(0.0)),
        "first": F.min_by(v, key),
        "last": F.max_by(v, key),
        "count": F.count(F.lit(1)),
    }
    return [exprs[s].alias(s) for s in stats]


def summarise(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str],
              stats: Sequence[str] = STAT_NAMES, quantiles: Sequence[float] = (),
              values_per_chunk: int = 1_000_000) -> DataFrame:
    """Ten statistics of ``value`` per group.

    All but the quantiles are partial aggregates of one ``groupBy``.  Median, IQR and further quantiles are selected on
    (group, value) counts (``quantiles.quantiles_by``, chunks of ``values_per_chunk`` distinct values), whatever a group's size.
    """
    from cohortkit.operators.quantiles import quantiles_by

    keys, stats = list(keys), list(stats)
    if not keys:  # the whole table as one group (of no rows: none)
        one = summarise(df.withColumn("_all", F.lit(0)), ["_all"], value, order, stats, quantiles, values_per_chunk)
        return one.drop("_all")
    plain = [s for s in stats if s not in ("median", "iqr")]
    named = [f"q{int(round(p * 100))}" for p in quantiles]
    aggs = stat_columns(value, order, plain) or [F.count(F.lit(1)).alias("_rows")]
    out = df.groupBy(*keys).agg(*aggs)
    if len(plain) < len(stats) or quantiles:
        q = quantiles_by(df, keys, value, [0.25, 0.5, 0.75, *quantiles], "_q", values_per_chunk)
        out = null_safe_join(out, q, keys)
        extra = {"median": F.col("_q")[1], "iqr": F.col("_q")[2] - F.col("_q")[0]}
        extra.update({n: F.col("_q")[3 + i] for i, n in enumerate(named)})
        out = out.withColumns({k: v for k, v in extra.items() if k in [*stats, *named]})
    return out.select(*keys, *stats, *named)


def count_by(df: DataFrame, c: str) -> DataFrame:
    """Rows per value, most frequent first."""
    return df.groupBy(c).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(c))


def top_k(df: DataFrame, by: str, k: int, ties: Sequence[str] = ()) -> DataFrame:
    """The ``k`` rows with the largest ``by`` (NULL last), ties by the ``ties`` columns ascending."""
    return df.orderBy(F.col(by).desc_nulls_last(), *[F.asc(c) for c in ties]).limit(k)


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """One row: negatives, positives, ratio neg/pos (NULL when there are no positives)."""
    return (df.agg(F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("negatives"),
                   F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("positives"))
            .withColumn("ratio", F.col("negatives") / F.when(F.col("positives") > 0, F.col("positives"))))


def case_rate(df: DataFrame, label: str, group: Sequence[str] = ()) -> DataFrame:
    """Prevalence (the no-skill precision), optionally per group."""
    agg = F.avg(F.col(label).cast("double")).alias("case_rate")
    return df.groupBy(*group).agg(agg) if group else df.agg(agg)


def schema_profile(df: DataFrame) -> DataFrame:
    """Per Spark type: number of columns and of their non-null values (one scan)."""
    counts = df.agg(F.array(*[F.struct(F.lit(t).alias("type"), F.count(F.col(f"`{c}`")).alias("n")) for c, t in df.dtypes])
                    .alias("cols"))
    return (counts.select(F.explode("cols").alias("c")).groupBy("c.type")
            .agg(F.count(F.lit(1)).alias("n_columns"), F.sum("c.n").alias("n_values")).orderBy("type"))
