"""Running sums over an ordered key without a single-task window.

A window ordered over a whole table (or a few huge groups) runs in one task.
Instead:

1. the caller pre-aggregates to one row per (group, distinct key);
2. rows are range-partitioned by (group, key) into as many chunks as the number of rows asks for (``ordered.positions``), or cut at
   split points that the caller reuses;
3. (group, chunk) totals are prefix-summed in blocks, and blocks of blocks (``ordered.totals_before``);
4. running sums inside each (group, chunk) use a window partitioned by (group, chunk), and the chunk's offset is added.

Results are exact; the ranges only balance the chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join in which NULL keys meet NULL keys; the keys of ``left`` are kept."""
    on = list(on)
    r = right.withColumnsRenamed({k: f"_r_{k}" for k in on})
    cond = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in on]
    return left.join(r, cond, how).drop(*[f"_r_{k}" for k in on])


def key_splits(df: DataFrame, key: str, n_chunks: int | None = None) -> list[float]:
    """Split points for ``running_sums(..., splits=...)`` when one key is reused."""
    if n_chunks is None:
        n_chunks = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return _splits(df.select(F.col(key).cast("double").alias("_k")), "_k", n_chunks)


def _splits(df: DataFrame, key: str, n_chunks: int) -> list[float]:
    if n_chunks <= 1:
        return [float("-inf"), float("inf")]
    probs = [i / n_chunks for i in range(1, n_chunks)]
    qs = df.approxQuantile(key, probs, 0.001)
    pts = sorted({float(q) for q in qs if q is not None})
    return [float("-inf")] + pts + [float("inf")]


def bucketize(df: DataFrame, col: str, splits: list[float], out: str) -> DataFrame:
    """Bucket index by sorted split points (JVM binary search); one bucket needs no splits."""
    if len(splits) < 3:
        return df.withColumn(out, F.lit(0.0))
    return Bucketizer(splits=splits, inputCol=col, outputCol=out, handleInvalid="keep").transform(df)


def running_sums(df: DataFrame, key: str, cols: Sequence[str], descending: bool = False,
                 inclusive: bool = True, partition_by: Sequence[str] = (), n_chunks: int | None = None,
                 prefix: str = "cum_", splits: list[float] | None = None,
                 keys_per_chunk: int = 50_000) -> DataFrame:
    """Add ``{prefix}{c}`` = sum of ``c`` over rows of the same group whose key is
    before this row's key (and the row itself when ``inclusive``).

    ``df`` must hold one row per (group, key).  ``descending`` sums from the
    largest key down (suffix sums, e.g. numbers at risk).
    """
    from cohortkit.operators.ordered import positions, totals_before

    cols = list(cols)
    parts = list(partition_by)
    if n_chunks is None and splits is None:
        n_chunks = max(1, -(-df.count() // keys_per_chunk))
    k = F.col(key).cast("double")
    base = df.withColumn("_k", -k if descending else k)
    if splits is None and n_chunks > 1:
        b = positions(base, [*parts, F.asc_nulls_last("_k")], n_chunks, "_at", "_b").drop("_at")
    else:
        cuts = [float("-inf"), float("inf")] if splits is None else sorted(-x for x in splits) if descending else splits
        b = bucketize(base, "_k", cuts, "_b")
    tot = b.groupBy(*parts, "_b").agg(*[F.sum(c).alias(c) for c in cols])
    offs = totals_before(tot, "_b", cols, parts, prefix="_o_")
    # with given splits and no groups the offsets have at most len(splits) rows; else their size is left to AQE's check
    offs_j = F.broadcast(offs) if splits is not None and not parts else offs
    frame = (Window.unboundedPreceding, 0 if inclusive else -1)
    wi = Window.partitionBy(*parts, "_b").orderBy(F.asc_nulls_last("_k")).rowsBetween(*frame)
    out = null_safe_join(b, offs_j, [*parts, "_b"])
    out = out.withColumns({f"{prefix}{c}": F.col(f"_o_{c}") + F.coalesce(F.sum(c).over(wi), F.lit(0))
                           for c in cols})
    return out.drop("_k", "_b", *[f"_o_{c}" for c in cols])
