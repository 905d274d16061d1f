"""Merging events closer than a gap into sessions (e.g. doses within an hour
count as one administration), without a per-key ordered window.

A row opens a new session when the previous row of its key is at least ``gap``
earlier.  With time cut into buckets of width ``gap``, only the first row of a
(key, bucket) can open a session (two rows in one bucket are closer than the
gap), and it does so exactly when the latest row of the previous bucket is at
least ``gap`` before it (an empty previous bucket means a larger gap).  So:

1. one grouped aggregate per (key, bucket): first row, last time, row count,
   smallest order value;
2. a join of that summary to itself shifted by one bucket gives the start flag;
3. session number = running count of starts over buckets, from the bucketed
   running-sum operator (a hot key is split over buckets, no one-task window);
4. one grouped aggregate per (key, session).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortkit.functions.columns import epoch_micros
from cohortkit.operators.prefix import running_sums


def merge_within(df: DataFrame, key: str, t: str, order: str, gap_seconds: float = 3600.0) -> DataFrame:
    """(key, session, first_order, n_events, start_time, end_time) per merged session.

    ``first_order`` is the smallest ``order`` value in the session.
    """
    gap = int(round(gap_seconds * 1_000_000))
    x = (df.select(F.col(key), epoch_micros(t).alias("_us"), F.col(order).alias("_o"))
         .filter(F.col("_us").isNotNull())
         .withColumn("_hb", F.floor(F.col("_us") / F.lit(gap)).cast("long")))
    per = x.groupBy(key, "_hb").agg(F.min(F.struct("_us", "_o")).alias("_first"), F.max("_us").alias("_last"),
                                    F.count(F.lit(1)).alias("_n"), F.min("_o").alias("_omin"))
    prev = per.select(F.col(key).alias("_pk"), (F.col("_hb") + 1).alias("_pb"), F.col("_last").alias("_plast"))
    flagged = (per.join(prev, F.col(key).eqNullSafe(F.col("_pk")) & (F.col("_hb") == F.col("_pb")), "left")
               .withColumn("_start", F.when(F.col("_plast").isNull()
                                            | (F.col("_first._us") - F.col("_plast") >= F.lit(gap)), 1)
                           .otherwise(0))
               .drop("_pk", "_pb", "_plast"))
    sess = running_sums(flagged, "_hb", ["_start"], partition_by=[key], prefix="s")
    return (sess.groupBy(key, F.col("s_start").alias("session"))
            .agg(F.min("_omin").alias("first_order"), F.sum("_n").alias("n_events"),
                 F.min("_first._us").alias("_s"), F.max("_last").alias("_e"))
            .withColumn("start_time", F.timestamp_micros("_s"))
            .withColumn("end_time", F.timestamp_micros("_e"))
            .drop("_s", "_e"))
