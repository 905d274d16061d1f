"""Sources and sinks: CSV (plain or gzip), Parquet, catalog tables, lookups, models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortkit.functions.columns import lower_columns

# Broadcast a lookup only below this many rows; the check runs before the hint.
LOOKUP_MAX_ROWS = 1_000_000


def read_table(spark: SparkSession, path_or_name: str, schema: T.StructType | str | None = None,
               fmt: str | None = None, columns: Sequence[str] | None = None,
               lower: bool = True, multi_line: bool = False) -> DataFrame:
    """Read a CSV (``.csv``/``.csv.gz``), Parquet file/folder or catalog table.

    * CSV: header row; an explicit ``schema`` is used when given (no inference
      pass over the data), else types are inferred.  Gzip is decoded by
      extension; gzip is not splittable, so large gzip inputs should be
      converted to Parquet once (``write_table``) and read from there.
      Quotes inside quoted cells are doubled, ``NA`` and empty cells are NULL.  With a
      schema, a row that does not fit it fails the read instead of shifting columns;
      ``multi_line`` allows line ends inside quoted cells (such files are not split).
    * A name without a path separator or extension is a catalog table.
    * ``columns`` keeps a subset; with Parquet the scan reads only those.
    """
    fmt = fmt or _guess_format(path_or_name)
    if fmt == "table":
        df = spark.table(path_or_name)
    elif fmt == "csv":
        r = (spark.read.option("header", True).option("escape", '"').option("nullValue", "NA")
             .option("mode", "PERMISSIVE" if schema is None else "FAILFAST").option("multiLine", multi_line))
        if schema is not None:
            r = r.schema(schema)
        else:
            r = r.option("inferSchema", True)
        df = r.csv(path_or_name)
    else:
        r = spark.read
        if schema is not None:
            r = r.schema(schema)
        df = r.format(fmt).load(path_or_name)
    if lower:
        df = lower_columns(df)
    if columns:
        df = df.select(*columns)
    return df


def _guess_format(p: str) -> str:
    q = p.lower()
    if q.endswith(".csv") or q.endswith(".csv.gz") or q.endswith(".tsv"):
        return "csv"
    if q.endswith(".json"):
        return "json"
    if q.endswith(".orc"):
        return "orc"
    if "/" not in p and "." not in q.rsplit("/", 1)[-1]:
        return "table"
    return "parquet"


def load_lookup(spark: SparkSession, path: str, schema=None, max_rows: int = LOOKUP_MAX_ROWS) -> DataFrame:
    """Small dimension read.  Its row count is checked before it is marked for broadcast."""
    df = read_table(spark, path, schema=schema, lower=False)
    return broadcast_if_small(df, max_rows)


def broadcast_if_small(df: DataFrame, max_rows: int = LOOKUP_MAX_ROWS) -> DataFrame:
    """Broadcast hint only behind a checked bound (``limit(max_rows+1).count()``)."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def write_table(df: DataFrame, path: str, fmt: str = "parquet", compression: str | None = None,
                mode: str = "overwrite", row_id: str | None = None, order_by: Sequence[str] | None = None,
                partition_by: Sequence[str] | None = None) -> None:
    """Write as Parquet (default) or CSV (``compression='gzip'`` for ``.csv.gz`` parts).

    ``row_id`` adds a 0-based row index over an explicit order (``order_by``),
    computed without a global single-partition window: rows are ranked inside
    sorted partitions and offset by the counts of earlier partitions.
    """
    if row_id:
        df = with_row_index(df, row_id, order_by or df.columns)
    w = df.write.mode(mode)
    if compression:
        w = w.option("compression", compression)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def with_row_index(df: DataFrame, name: str, order_by: Sequence[str],
                   rows_per_partition: int = 1_000_000) -> DataFrame:
    """Dense 0-based index over ``order_by`` using range partitions + per-partition offsets."""
    spark = df.sparkSession
    cap = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    nparts = max(1, min(cap, -(-df.count() // rows_per_partition)))  # ~rows_per_partition rows each
    ranged = df.repartitionByRange(nparts, *order_by).sortWithinPartitions(*order_by)
    ranged = ranged.withColumn("_pid", F.spark_partition_id())
    from cohortkit.session import materialize

    ranged = materialize(ranged, "rowindex")  # one fixed partitioning for both passes
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    wl = Window.partitionBy("_pid").orderBy(*order_by)
    return (ranged.join(F.broadcast(offs), "_pid")  # one row per partition: bounded
            .withColumn(name, F.col("_off") + F.row_number().over(wl) - 1)
            .drop("_pid", "_off"))


def save_model(model, path: str, overwrite: bool = True) -> None:
    """Persist a Spark ML model/pipeline (MLWriter)."""
    w = model.write()
    if overwrite:
        w = w.overwrite()
    w.save(path)


def load_model(path: str, cls=None):
    """Load a model saved by ``save_model``; ``cls`` defaults to a PipelineModel."""
    if cls is None:
        from pyspark.ml import PipelineModel as cls  # noqa: N813
    return cls.load(path)


def stage_as_parquet(spark: SparkSession, src: str, dst: str, schema=None, num_partitions: int | None = None,
                     partition_by: Sequence[str] | None = None) -> DataFrame:
    """Convert a (gzip) CSV to Parquet once and return the Parquet-backed frame.

    A ``.csv.gz`` file is read by a single task (gzip is not splittable);
    repartitioning before the write spreads every later scan over many tasks
    and gives later steps column pruning and filter pushdown.
    """
    df = read_table(spark, src, schema=schema)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    w = df.repartition(n).write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(dst)
    return spark.read.parquet(dst)
