"""A global order in DataFrames: unique positions, chunks of bounded size, and sums over all earlier chunks.

Rows are range-partitioned and sorted by any columns, and written once: a row's chunk is its partition, its position the
partition's number and its place inside.  No split points reach the driver, equal keys may span chunks, and the number of chunks
follows from the number of rows alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortkit.operators.prefix import null_safe_join
from cohortkit.session import materialize

CHUNK_BITS = 33  # monotonically_increasing_id: the partition's number above, the row's place below


def positions(df: DataFrame, order: Sequence[str | Column], n_chunks: int, pos: str = "_pos",
              chunk: str = "_chunk", frees: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Materialized ``df`` with a unique ``pos`` that follows ``order``, and the ``chunk`` (of about equal sizes) it lies in."""
    order = list(order)
    d = df.repartitionByRange(n_chunks, *order) if n_chunks > 1 else df.coalesce(1)
    d = d.sortWithinPartitions(*order).withColumn(pos, F.monotonically_increasing_id())
    return materialize(d.withColumn(chunk, F.shiftright(pos, CHUNK_BITS)), "ordered", frees)


def totals_before(totals: DataFrame, chunk: str, cols: Sequence[str], partition_by: Sequence[str] = (),
                  after: bool = False, prefix: str = "_o_", fan: int = 1024) -> DataFrame:
    """(partition_by, chunk, prefix + c): sums of ``cols`` over the earlier (``after``: later) chunks of a group.

    totals: one row per (group, chunk).  Chunks are summed inside blocks of ``fan`` chunks, blocks inside blocks of blocks, so a
    window holds ``fan`` rows however many chunks there are.
    """
    parts, cols = list(partition_by), list(cols)
    key = -F.col(chunk) if after else F.col(chunk)
    block, above = f"{chunk}_block", f"{prefix}above_"
    t = totals.select(*parts, chunk, F.floor(F.col(chunk) / F.lit(fan)).cast("long").alias(block), *cols)
    w = Window.partitionBy(*parts, block).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    inside = t.select(*parts, chunk, block, *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(prefix + c) for c in cols])
    span = t.agg(F.min(block).alias("a"), F.max(block).alias("b")).first()
    if span["a"] == span["b"]:
        return inside.drop(block)
    blocks = t.groupBy(*parts, block).agg(*[F.sum(c).alias(c) for c in cols])
    upper = totals_before(blocks, block, cols, parts, after, above, fan)
    joined = null_safe_join(inside, upper, [*parts, block])
    return joined.select(*parts, chunk, *[(F.col(prefix + c) + F.col(above + c)).alias(prefix + c) for c in cols])
