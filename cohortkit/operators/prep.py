"""Preparation for modelling: imputation, reproducible splits and folds, class
weights, feature assembly and standardisation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortkit.functions.columns import nan_to_null
from cohortkit.operators.prefix import null_safe_join
from cohortkit.operators.quantiles import exact_quantiles


def normalise_missing(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NaN to NULL on floating columns, so every missing marker is NULL."""
    cols = cols or [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: nan_to_null(c) for c in cols})


def impute_mean(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fill NULL with the column mean (one aggregate job, partial sums map-side)."""
    cols = list(cols)
    row = df.agg(*[F.avg(c).alias(c) for c in cols]).collect()[0]  # one row
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(row[c]).cast("double")) for c in cols})


def median_values(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    """Exact medians of whole columns (type-7, as numpy/pandas); no single-task group."""
    return {c: v[0] for c, v in exact_quantiles(df, cols, [0.5]).items()}


def impute_median(df: DataFrame, cols: Sequence[str], medians: dict | None = None,
                  all_null: str = "keep") -> DataFrame:
    """Fill NULL with the exact column median.

    ``medians`` lets a split be imputed with statistics fitted on another frame
    (fit/transform).  An all-NULL column is kept NULL (``all_null='keep'``) or
    raises (``'error'``).
    """
    cols = list(cols)
    med = medians if medians is not None else median_values(df, cols)
    bad = [c for c in cols if med.get(c) is None]
    if bad and all_null == "error":
        raise ValueError(f"all-null columns: {bad}")
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(med.get(c)).cast("double"))
                           for c in cols})


def hash_rank_key(key_cols: Sequence[str], seed: int | str) -> F.Column:
    """md5 of ``seed:key`` — the shared, engine-independent shuffle order."""
    parts = [F.lit(str(seed)), F.lit(":")]
    for i, k in enumerate(key_cols):
        if i:
            parts.append(F.lit("|"))
        parts.append(F.coalesce(F.col(k).cast("string"), F.lit("NA")))
    return F.md5(F.concat(*parts))


def split_exact(df: DataFrame, key_cols: Sequence[str], test_frac: float = 0.2, seed: int = 0,
                name: str = "is_test") -> DataFrame:
    """Exact-size shuffled split: the ``ceil(test_frac * n)`` rows with the smallest
    ``md5(seed:key)`` form the test set (``name`` = 1).

    Rows that share a key fall on the same side, so with repeated keys the test set is the
    smallest one of at least that size.  The cut point is the k-th smallest hash, found from bounded per-prefix
    counts (``kth_hash``), so no global sort or single-task window runs.
    """
    d = df.withColumn("_h", hash_rank_key(key_cols, seed))
    cut = kth_hash(d, "_h", lambda n: int(-(-test_frac * n // 1)))  # ceil
    return d.withColumn(name, (F.col("_h") <= F.lit(cut)).cast("int") if cut is not None else F.lit(0)).drop("_h")


def kth_hash(df: DataFrame, hcol: str, k: int | Callable[[int], int]) -> str | None:
    """The k-th smallest value of a hex string column; ``k`` may be a function of the row count.

    Each round counts rows per next three hex digits under the prefix found so far (4,096 rows at
    most) with their least and greatest hash, until the group that holds rank k has one hash only.
    Repeated hashes are counted, never fetched.
    """
    prefix, below = "", 0
    while True:
        cand = df.filter(F.col(hcol).startswith(prefix)) if prefix else df.filter(F.col(hcol).isNotNull())
        groups = sorted(tuple(r) for r in cand.groupBy(F.substring(hcol, len(prefix) + 1, 3).alias("d"))
                        .agg(F.count(F.lit(1)).alias("n"), F.min(hcol).alias("lo"), F.max(hcol).alias("hi")).collect())
        if callable(k):
            k = k(sum(g[1] for g in groups))
        if k <= 0:
            return None
        for digits, n, lo, hi in groups:
            if below + n >= k:
                break
            below += n
        else:
            return groups[-1][3] if groups else None  # k beyond the rows: all of them
        if lo == hi:
            return lo
        prefix += digits


def stratified_folds(df: DataFrame, key_cols: Sequence[str], label: str, k: int = 4, seed: int = 0,
                     name: str = "fold") -> DataFrame:
    """Fold id in [0, k): rows ranked by ``md5(seed:key)`` within each class, fold = rank mod k.

    Every fold keeps the class ratio (sizes differ by at most one per class).
    The hash is uniform: rows are numbered inside (class, first three hex digits), after
    the prefix sum of the 4,096 counts before, so no class is numbered in one task.  NULL is a class.
    """
    d = df.withColumn("_h", hash_rank_key(key_cols, seed)).withColumn("_b", F.substring("_h", 1, 3))
    before = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = d.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_n"))
    offs = offs.select(label, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    rank = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h")) - 1
    return (null_safe_join(d, offs, [label, "_b"]).withColumn(name, ((F.col("_o") + rank) % k).cast("int"))
            .drop("_h", "_b", "_o"))


def class_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Positives weighted by negatives/positives, negatives by 1."""
    row = df.agg(F.sum((F.col(label) == 0).cast("long")).alias("neg"),
                 F.sum((F.col(label) == 1).cast("long")).alias("pos")).collect()[0]
    ratio = (row["neg"] / row["pos"]) if row["pos"] else 1.0
    return df.withColumn(name, F.when(F.col(label) == 1, F.lit(float(ratio))).otherwise(F.lit(1.0)))


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    """Feature vector column (NULL kept as NaN: ``handleInvalid='keep'``)."""
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep").transform(df)


def standardise(df: DataFrame, cols: Sequence[str], stats: dict | None = None) -> DataFrame:
    """Zero mean, unit *population* sd (as the reference's scaler); constant columns give 0."""
    cols = list(cols)
    if stats is None:
        stats = standardise_stats(df, cols)
    return df.withColumns({
        c: (F.col(c) - F.lit(stats[c][0])) / F.lit(stats[c][1] if stats[c][1] else 1.0) for c in cols})


def standardise_stats(df: DataFrame, cols: Sequence[str]) -> dict:
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    row = df.agg(*aggs).collect()[0]
    return {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in cols}
