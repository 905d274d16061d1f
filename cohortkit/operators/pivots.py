"""Pivots: presence one-hot and multi-measure wide pivots, with explicit values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_hot_pivot(df: DataFrame, ids: Sequence[str], c: str, values: Sequence[str],
                  prefix: str = "", fill: int = 0, drop_unused: bool = False) -> DataFrame:
    """One row per distinct ``ids``; ``{prefix}{value}`` is 1 if the value occurs, else ``fill``.

    Written as conditional ``max`` over an explicit value list, which is what a
    Spark pivot plans to, but with a static schema and no discovery job.
    Columns other than ``ids`` and ``c`` are dropped, as in the reference.
    ``drop_unused`` keeps only values that occur (reference: only observed
    levels become columns); it costs one small distinct job.
    """
    if drop_unused:
        seen = {r[0] for r in df.select(c).distinct().collect()}  # bounded by len(values)
        values = [v for v in values if v in seen]
    aggs = [F.max(F.when(F.col(c) == F.lit(v), F.lit(1))).alias(f"{prefix}{v}") for v in values]
    out = df.groupBy(*ids).agg(*aggs) if aggs else df.select(*ids).distinct()
    if fill is not None and values:
        out = out.fillna(fill, subset=[f"{prefix}{v}" for v in values])
    return out


def wide_pivot(df: DataFrame, ids: Sequence[str], c: str, values: Sequence[str],
               measures: Sequence[str], sep: str = "_") -> DataFrame:
    """Multi-measure pivot; column ``{measure}{sep}{value}``; absent stays NULL."""
    aggs = [F.first(F.when(F.col(c) == F.lit(v), F.col(m)), ignorenulls=True).alias(f"{m}{sep}{v}")
            for v in values for m in measures]
    return df.groupBy(*ids).agg(*aggs)


def unpivot_long(df: DataFrame, ids: Sequence[str], value_cols: Sequence[str],
                 variable: str = "variable", value: str = "value") -> DataFrame:
    """Long form (melt) of selected columns."""
    return df.unpivot(list(ids), list(value_cols), variable, value)
