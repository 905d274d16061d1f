"""Exact quantiles of groups or whole columns by selection on value counts; one plan for every size of group.

Rows are reduced to (group, value) counts with partial sums on the map side, running counts within the group come
from ``prefix.running_sums`` (whose chunks cut a large group as they cut the table), and the one or two ranks of
each probability are picked where the running count passes them.  No task holds the values of a group.
Type-7 interpolation as R's ``quantile`` / numpy's default.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortkit.operators.prefix import null_safe_join, running_sums


def quantiles_by(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], out: str = "_q",
                 values_per_chunk: int = 1_000_000) -> DataFrame:
    """(keys, ``out``: array of one quantile per probability); NULL values are left out, NaN is the largest value.

    A group of NULL values only has no row.  NULL is a key like any other.
    """
    keys = list(keys)
    if not keys:
        return quantiles_by(df.withColumn("_all", F.lit(0)), ["_all"], value, probs, out, values_per_chunk).drop("_all")
    v = F.col(value).cast("double")
    counts = df.select(*keys, v.alias("_v")).filter(F.col("_v").isNotNull()).groupBy(*keys, "_v").agg(
        F.count(F.lit(1)).alias("_n"))
    run = running_sums(counts, "_v", ["_n"], partition_by=keys, keys_per_chunk=values_per_chunk)
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    run = null_safe_join(run, totals, keys, "inner")

    def rank(whole):  # the value whose running count takes in the rank
        return F.max(F.when((whole >= F.col("cum__n") - F.col("_n")) & (whole < F.col("cum__n")), F.col("_v")))

    picked = []
    for i, p in enumerate(probs):
        at = (F.col("_total") - 1) * F.lit(float(p))
        picked += [rank(F.floor(at)).alias(f"_a{i}"), rank(F.ceil(at)).alias(f"_b{i}"), F.max(at - F.floor(at)).alias(f"_f{i}")]
    q = [F.when(F.col(f"_a{i}") == F.col(f"_b{i}"), F.col(f"_a{i}"))
         .otherwise(F.col(f"_a{i}") + F.col(f"_f{i}") * (F.col(f"_b{i}") - F.col(f"_a{i}"))) for i in range(len(probs))]
    return run.groupBy(*keys).agg(*picked).select(*keys, F.array(*q).alias(out))


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    values_per_chunk: int = 1_000_000) -> dict[str, list[float | None]]:
    """{column: [quantile per prob]} over values that are neither NULL nor NaN; None for a column without any."""
    cols = list(cols)
    if not cols:
        return {}
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_x")) for c in cols]))
                     .alias("_s")).select("_s._c", "_s._x").filter(F.col("_x").isNotNull() & ~F.isnan("_x"))
    found = {r["_c"]: list(r["_q"]) for r in quantiles_by(long, ["_c"], "_x", probs, "_q", values_per_chunk).collect()}
    return {c: found.get(c, [None] * len(probs)) for c in cols}  # one row a column
