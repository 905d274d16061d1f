"""Scalar column helpers (projections, predicates, conditionals, time maths).

All are built-in Spark expressions, so they stay inside whole-stage codegen.
The null rules follow the reference's R semantics where they differ from
Spark's defaults; each such place says so.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICROS_PER_SECOND = 1_000_000
SECONDS_PER_HOUR = 3600
SECONDS_PER_DAY = 86400
SECONDS_PER_YEAR = 365 * 86400


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- projections
def lower_columns(df: DataFrame) -> DataFrame:
    """Lower-case every column name (sources differ in header case)."""
    return df.toDF(*[c.lower() for c in df.columns])


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


def project(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols)


def drop_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.drop(*cols)


def select_features(df: DataFrame, patterns: Sequence[str] = (), extra: Sequence[str] = ()) -> list[str]:
    """Column names containing any substring in ``patterns`` or listed in ``extra``, in frame order."""
    extra = set(extra)
    return [c for c in df.columns if c in extra or any(p in c for p in patterns)]


def with_columns(df: DataFrame, exprs: Mapping[str, Column]) -> DataFrame:
    return df.withColumns(dict(exprs))


# ----------------------------------------------------------------- predicates
def filter_eq(df: DataFrame, c: str, value) -> DataFrame:
    return df.filter(F.col(c) == F.lit(value))


def filter_in(df: DataFrame, c: str, values) -> DataFrame:
    """Membership in a list (``isin``) or in a lookup frame's column (left semi join)."""
    if isinstance(values, DataFrame):
        other = values.select(F.col(values.columns[0]).alias(c)) if c not in values.columns else values.select(c)
        return df.join(other, on=c, how="left_semi")
    return df.filter(F.col(c).isin(list(values)))


def filter_range(df: DataFrame, c: str, lo=None, hi=None, bounds: str = "()") -> DataFrame:
    """Conjunctive range; NULL fails every bound (as R's ``filter``)."""
    cond = F.col(c).isNotNull()
    if lo is not None:
        cond = cond & ((F.col(c) >= lo) if bounds[0] == "[" else (F.col(c) > lo))
    if hi is not None:
        cond = cond & ((F.col(c) <= hi) if bounds[1] == "]" else (F.col(c) < hi))
    return df.filter(cond)


def filter_lt(df: DataFrame, c: str, v) -> DataFrame:
    return df.filter(F.col(c) < v)


# --------------------------------------------------------------- conditionals
def flag(cond: Column) -> Column:
    """1/0 that stays NULL when the condition is NULL (R ``ifelse`` semantics).

    ``F.when(cond, 1).otherwise(0)`` would turn NULL into 0.
    """
    return cond.cast("int")


def fill_null(c, value) -> Column:
    return F.coalesce(col(c), F.lit(value))


def nan_to_null(c) -> Column:
    """Unify missing markers: NaN becomes NULL."""
    return F.nanvl(col(c), F.lit(None).cast("double"))


def case_first(pairs: Sequence[tuple[Column, Column]], default: Column | None = None) -> Column:
    expr = None
    for cond, val in pairs:
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return expr if default is None else expr.otherwise(default)


def map_codes(c, mapping: Mapping, default=None) -> Column:
    """Code to name by an ordered multi-way case."""
    return case_first([(col(c) == F.lit(k), F.lit(v)) for k, v in mapping.items()],
                      None if default is None else F.lit(default))


def pmax(c, floor_value) -> Column:
    """Element-wise max with a floor that keeps NULL as NULL (R ``pmax``).

    Spark's ``greatest`` ignores NULL, so it is guarded.
    """
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(c, F.lit(floor_value)))


def paste(*cols, sep: str = "_", na: str = "NA") -> Column:
    """String paste where a missing part is written as ``na`` (R ``paste``).

    ``concat_ws`` alone would skip NULL parts silently.
    """
    return F.concat_ws(sep, *[F.coalesce(col(c).cast("string"), F.lit(na)) for c in cols])


# ------------------------------------------------------------------ time maths
def epoch_seconds(c) -> Column:
    """Seconds since the epoch as double; works for timestamp and timestamp_ntz."""
    return F.unix_micros(col(c).cast("timestamp")) / F.lit(float(MICROS_PER_SECOND))


def epoch_micros(c) -> Column:
    return F.unix_micros(col(c).cast("timestamp"))


def seconds_between(start, end) -> Column:
    return (epoch_micros(end) - epoch_micros(start)) / F.lit(float(MICROS_PER_SECOND))


def years_between(start, end) -> Column:
    """Duration in 365-day years."""
    return seconds_between(start, end) / F.lit(float(SECONDS_PER_YEAR))


def hours_between(start, end) -> Column:
    return seconds_between(start, end) / F.lit(float(SECONDS_PER_HOUR))


def days_between(start, end) -> Column:
    return seconds_between(start, end) / F.lit(float(SECONDS_PER_DAY))


def to_day(c) -> Column:
    """Truncate an instant to its UTC date (as a timestamp at midnight)."""
    return F.to_date(col(c)).cast("timestamp")


def add_days(c, n: float) -> Column:
    """Instant plus n exact 86400-second days."""
    return col(c).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(n) * SECONDS_PER_DAY))


def hour_of_day(c) -> Column:
    return F.hour(col(c)).cast("double")


def in_interval(t, lo, hi) -> Column:
    """Point within [lo, hi], both ends inclusive; NULL if any side is NULL."""
    return flag(col(t).between(col(lo), col(hi)))


def round_cols(df: DataFrame, digits: int = 6, cols: Sequence[str] | None = None) -> DataFrame:
    """Round floating columns (used only for stable comparisons)."""
    targets = cols or [n for n, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.round(F.col(c), digits) for c in targets})


def cast_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Cast named columns (e.g. a 0/1 flag to boolean, counts to double)."""
    return df.withColumns({c: F.col(c).cast(t) for c, t in mapping.items()})


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """First rows (a limit; the feature is the head, not a cap on results)."""
    return df.limit(n)


def shape(df: DataFrame) -> tuple[int, int]:
    """(rows, columns): one count job plus schema metadata."""
    return df.count(), len(df.columns)
