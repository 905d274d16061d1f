"""Derived cohort columns: age, elapsed time, stay flag, labels, survival target, QC."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortkit.functions.columns import (add_days, case_first, days_between, epoch_micros, flag, hour_of_day,
                                         hours_between, in_interval, pmax, to_day, years_between)
from cohortkit.operators.prefix import null_safe_join

HORIZONS = (2, 7, 30)
LAG_DAYS = 1


def age_at(df: DataFrame, dob: str, t0: str, name: str = "age_at_admin") -> DataFrame:
    """Years (365-day) from birth to the date of ``t0``."""
    return df.withColumn(name, years_between(dob, to_day(t0)))


def hours_since(df: DataFrame, start: str, t0: str, name: str = "admin_time_since_admission") -> DataFrame:
    """Hours between the dates of ``start`` and ``t0``, floored at 0 (NULL stays NULL)."""
    return df.withColumn(name, pmax(hours_between(to_day(start), to_day(t0)), 0))


def in_stay(df: DataFrame, t: str, lo: str, hi: str, name: str = "in_icu") -> DataFrame:
    return df.withColumn(name, in_interval(t, lo, hi))


def time_of_day(df: DataFrame, t: str, name: str = "admission_time_of_day") -> DataFrame:
    return df.withColumn(name, hour_of_day(t))


def test_window(test_t: str, t0: str, horizon: float, lag: float = LAG_DAYS) -> Column:
    """Outcome test time in [t0+lag, t0+horizon] (both inclusive); NULL if no test."""
    tt = F.col(test_t).cast("timestamp")
    return (tt >= add_days(t0, lag)) & (tt <= add_days(t0, horizon))


def code_window(code_col: str, code: str, end_t: str, t0: str, horizon: float, lag: float = LAG_DAYS,
                as_executed: bool = False) -> Column:
    """Code present and end of stay in (t0+lag, t0+horizon].

    ``as_executed`` reproduces the reference's 2-day branch, whose bounds
    contradict each other (end <= t0+1d and end > t0+1d), so it never fires.
    """
    e = F.col(end_t).cast("timestamp")
    hi = add_days(t0, lag) if (as_executed and horizon == 2) else add_days(t0, horizon)
    return (F.col(code_col) == F.lit(code)) & (e <= hi) & (e > add_days(t0, lag))


def label_windows(df: DataFrame, test_t: str, code_col: str, code: str, end_t: str, t0: str,
                  horizons: Sequence[float] = HORIZONS, lag: float = LAG_DAYS, as_executed: bool = False,
                  name: str = "cdiff_{h}d_flag") -> DataFrame:
    """``test-in-window OR (code AND end in window)``, as 1/0 with NULL filled by 0."""
    return df.withColumns({
        name.format(h=int(h)): F.coalesce(
            flag(test_window(test_t, t0, h, lag) | code_window(code_col, code, end_t, t0, h, lag, as_executed)),
            F.lit(0))
        for h in horizons})


def label_by_source(df: DataFrame, test_t: str, code_col: str, code: str, end_t: str, t0: str,
                    horizons: Sequence[float] = HORIZONS, lag: float = LAG_DAYS,
                    test_name: str = "cdiff_label_elisa_{h}d", code_name: str = "cdiff_label_icd9_{h}d") -> DataFrame:
    """Per-source flags, NOT filled: NULL where the source is missing."""
    exprs = {}
    for h in horizons:
        exprs[test_name.format(h=int(h))] = flag(test_window(test_t, t0, h, lag))
    for h in horizons:
        exprs[code_name.format(h=int(h))] = flag(code_window(code_col, code, end_t, t0, h, lag))
    return df.withColumns(exprs)


def survival_target(df: DataFrame, test_t: str, end_t: str, t0: str, horizon: float = 30,
                    lag: float = LAG_DAYS, event: str = "label", label_col: str = "cdiff_30d_flag",
                    flag_name: str = "cdiff_survival_flag", time_name: str = "survival_time") -> DataFrame:
    """Event flag and time in days.

    * ``event='label'`` (reference as run): the flag equals the filled
      ``label_col``; ``event='test'``: flag from the test window alone.
    * time stops at the test if the test is in window, else at end of stay.
    """
    in_win = test_window(test_t, t0, horizon, lag)
    if event == "label":
        fl = F.coalesce(F.col(label_col), F.lit(0))
    else:
        fl = F.coalesce(flag(in_win), F.lit(0))
    t = case_first([(in_win, days_between(t0, test_t))], days_between(t0, end_t))
    return df.withColumns({flag_name: fl, time_name: t})


def qc_filter(df: DataFrame, age: str = "age_at_admin", elapsed: str = "admin_time_since_admission",
              max_age: float = 100.0, max_hours: float = 60 * 24) -> DataFrame:
    """``age < max_age`` and ``elapsed <= max_hours``; NULL fails both."""
    return df.filter((F.col(age) < max_age) & (F.col(elapsed) <= max_hours))


def composite_label(df: DataFrame, test_t: str, t0: str, code_col: str, code: str, horizon: float = 30,
                    lag: float = LAG_DAYS, name: str = "composite_{h}d") -> DataFrame:
    """Positive test in [t0+lag, t0+horizon] AND a second code present (e.g. a
    diarrhoea diagnosis), as 1/0 with NULL filled by 0."""
    cond = test_window(test_t, t0, horizon, lag) & (F.col(code_col) == F.lit(code))
    return df.withColumn(name.format(h=int(horizon)), F.coalesce(flag(cond), F.lit(0)))


def outcome_within(index: DataFrame, tests: DataFrame, key: str, t0: str, test_t: str,
                   horizon: float = 30, lag: float = LAG_DAYS, name: str = "outcome") -> DataFrame:
    """``index`` with ``name``: 1 if some test of the same key lies in [t0+lag, t0+horizon], else 0.

    No index-test pairs: a window of (horizon - lag) days starting at t0+lag touches at most two buckets of that
    width, so the next test is the first later one in the row's own (key, bucket) or else the earliest of the
    following bucket.  NULL keys and times have no test.
    """
    width = max(1, int((horizon - lag) * 86_400_000_000))
    start = epoch_micros(add_days(t0, lag))
    i = index.withColumns({"_s": start, "_b": F.floor(start / width)})
    t = (tests.select(F.col(key).alias("_k"), epoch_micros(test_t).alias("_u"))
         .filter(F.col("_k").isNotNull() & F.col("_u").isNotNull()).withColumn("_b", F.floor(F.col("_u") / width)))
    first = t.groupBy("_k", "_b").agg(F.min("_u").alias("_next"))
    x = i.select(F.col(key).alias("_k"), "_b", F.col("_s").alias("_at"), F.lit(1).alias("_i"), F.struct(*index.columns).alias("_r"))
    later = F.min(F.when(F.col("_i") == 0, F.col("_at"))).over(
        Window.partitionBy("_k", "_b").orderBy("_at").rangeBetween(Window.currentRow, Window.unboundedFollowing))
    both = x.unionByName(t.groupBy("_k", "_b", F.col("_u").alias("_at")).agg(F.lit(0).alias("_i")), allowMissingColumns=True)
    both = both.withColumn("_own", later).filter(F.col("_i") == 1).withColumn("_after", F.col("_b") + 1)
    both = both.join(first.select("_k", F.col("_b").alias("_after"), "_next"), ["_k", "_after"], "left")
    hit = F.coalesce("_own", "_next") <= epoch_micros(add_days(F.col(f"_r.{t0}"), horizon))
    return both.select("_r.*", F.coalesce(hit.cast("int"), F.lit(0)).alias(name))


def prior_code_flags(index: DataFrame, codes: DataFrame, keys: Sequence[str], t0: str, code_t: str, code_col: str,
                     values: Sequence[str], prefix: str = "prior_") -> DataFrame:
    """``index`` with ``{prefix}{value}``: 1 if the key had that code strictly before ``t0``, else 0.

    One row per key (first time of each code) is joined, so no rows multiply; a NULL key meets the NULL key.
    """
    first = codes.groupBy(*keys).agg(*[F.min(F.when(F.col(code_col) == F.lit(v), F.col(code_t))).alias(f"_t{n}")
                                       for n, v in enumerate(values)])
    x = null_safe_join(index, first, keys)
    x = x.withColumns({f"{prefix}{v}": F.coalesce((F.col(f"_t{n}") < F.col(t0)).cast("int"), F.lit(0))
                       for n, v in enumerate(values)})
    return x.drop(*[f"_t{n}" for n in range(len(values))])
