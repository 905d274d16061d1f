"""Session construction and lineage cutting."""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: UTC so epoch maths on timestamp_ntz columns is
# stable, AQE for runtime coalescing / skew splitting of sort-merge joins.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.pivotMaxValues": "100000",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "cohortkit", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    for k, v in conf.items():
        if not k.startswith("spark.driver") and not k.startswith("spark.executor"):
            try:
                spark.conf.set(k, v)
            except Exception:  # static conf on a running session
                pass
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only when the setting is absent (local tests) is a private folder created.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/...) for this cluster")
        d = tempfile.mkdtemp(prefix="cohortkit-ckpt-")  # local mode only (tests, laptops)
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_freeing: list[str] = []  # the setting before, once for each thread inside
_lock = threading.Lock()


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Inside, a query's shuffle files go when the query ends, not when the driver collects its garbage.

    Threads may be inside together; the setting returns when the last one leaves.
    """
    with _lock:
        _freeing.append(_freeing[0] if _freeing else spark.conf.get(SHUFFLE_CLEANUP, "false"))
        spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            old = _freeing.pop()
            if not _freeing:
                spark.conf.set(SHUFFLE_CLEANUP, old)


def materialize(df: DataFrame, name: str | None = None, frees: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Cut lineage by writing ``df`` as Parquet under the shared checkpoint folder.

    A written table survives executor loss (unlike a local checkpoint) and the
    re-read plan starts from files, so later stages do not recompute upstream.
    The shuffles of the write go with it.  ``frees``: materialized tables that nothing reads
    any more once ``df`` is written; they are deleted.
    """
    spark = df.sparkSession
    base = checkpoint_dir(spark).rstrip("/")
    path = f"{base}/{name or 'stage'}-{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        df.write.mode("overwrite").parquet(path)
    release(*frees)
    out = spark.read.parquet(path)
    out._stage_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote (frames from elsewhere, and derived ones, are left alone)."""
    for f in frames:
        path = f.__dict__.pop("_stage_path", None)
        if path:
            spark = f.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
