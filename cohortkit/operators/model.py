"""Boosted-tree classifiers: fit, grid search over stratified folds, refit,
prediction, multi-horizon evaluation and split-count importance."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortkit.operators.metrics import average_precision, classification_report, roc_auc
from cohortkit.operators.summaries import top_k
from cohortkit.session import materialize, release

# Reference grid (trees x depth x learning rate = 4 x 4 x 2 points).
REFERENCE_GRID = {"maxIter": [50, 70, 100, 150], "maxDepth": [3, 5, 7, 9], "stepSize": [0.1, 0.2]}


def boosted(label: str = "label", features: str = "features", weight: str | None = None,
            seed: int = 0, max_bins: int = 64, **params) -> GBTClassifier:
    """Logistic-loss gradient-boosted trees."""
    est = GBTClassifier(labelCol=label, featuresCol=features, seed=seed, maxBins=max_bins, lossType="logistic")
    if weight:
        est = est.setWeightCol(weight)
    return est.setParams(**params) if params else est


def fit_boosted(df: DataFrame, label: str, features: str = "features", weight: str | None = None,
                seed: int = 0, **params) -> GBTClassificationModel:
    return boosted(label, features, weight, seed, **params).fit(df)


def staged_scores(model: GBTClassificationModel, df: DataFrame, stages: Sequence[int]) -> DataFrame:
    """``df`` with ``score_{n}``: the positive probability after the first n trees, for each n of ``stages``.

    Boosting is sequential, so a model's first n trees and their weights are those of a fit of n trees.  The trees between two
    stages are a model of their own; margins add up, and no tree is evaluated twice.
    """
    sc = df.sparkSession.sparkContext
    trees, weights = model._java_obj.trees(), model._java_obj.treeWeights()
    make = sc._jvm.org.apache.spark.ml.classification.GBTClassificationModel
    at, margin = 0, F.lit(0.0)
    for n in sorted(stages):
        part = GBTClassificationModel(make(f"{model.uid}-{at}-{n}", trees[at:n], weights[at:n], model.numFeatures, 2))
        part.setFeaturesCol(model.getFeaturesCol()).setProbabilityCol("").setPredictionCol("").setRawPredictionCol(f"_raw_{n}")
        df = part.transform(df)
        margin = margin + vector_to_array(F.col(f"_raw_{n}"))[1]
        df = df.withColumn(f"score_{n}", 1 / (1 + F.exp(-2 * margin)))
        at = n
    return df.drop(*[f"_raw_{n}" for n in stages])


def grid_search(df: DataFrame, label: str, grid: Mapping[str, Sequence], fold_col: str,
                features: str = "features", weight: str | None = None, seed: int = 0,
                parallelism: int | None = None, num_folds: int | None = None, cells: int = 1 << 22) -> list[dict]:
    """Exhaustive grid over given folds: for each grid point its parameters and ``score`` (mean exact AUC over the folds).

    Points that differ in ``maxIter`` alone are stages of one chain: a chain is fitted once per fold with the most trees,
    and all its stages are scored in one pass over the fold.  Fits run ``parallelism`` at a time (default: the cores that Spark
    counts on), the dearest first, on one copy of the rows whose partitions hold ``cells`` feature values each, so a small table
    is not spread over more tasks than it can feed.  AUCs of all points and folds come from one grouped job.
    """
    spark = df.sparkSession
    grid = {k: list(v) for k, v in grid.items()}
    stages = sorted(set(grid.get("maxIter", [boosted().getMaxIter()])))
    names = [n for n in grid if n != "maxIter"]
    chains = [dict(zip(names, v)) for v in itertools.product(*(grid[n] for n in names))]
    x = df.select(F.col(label).cast("double").alias("_y"), F.col(features).alias("_x"),
                  *([F.col(weight).alias("_w")] if weight else []), F.col(fold_col).alias("_f"))
    x = materialize(x.filter(F.col("_y").isNotNull() & F.col("_f").isNotNull()), "boost-rows")
    first = x.select("_x").first()
    size = x.count() * (len(first["_x"]) if first else 0)
    if num_folds is None:
        num_folds = int(x.agg(F.max("_f")).first()[0]) + 1
    x = x.coalesce(max(1, -(-size // cells))).persist()

    def chain(i: int, fold: int) -> DataFrame:
        est = boosted("_y", "_x", "_w" if weight else None, seed, maxIter=stages[-1], **chains[i])
        model = est.fit(x.filter(F.col("_f") != fold))
        held = staged_scores(model, x.filter(F.col("_f") == fold), stages)
        points = F.array(*[F.struct(F.lit(n).alias("maxIter"), F.col(f"score_{n}").alias("score")) for n in stages])
        held = held.select(F.lit(i).alias("chain"), "_f", F.col("_y").cast("int").alias("_y"), F.explode(points).alias("p"))
        return materialize(held.select("chain", "_f", "_y", "p.*"), "boost-scores")

    order = sorted(range(len(chains)), key=lambda i: -chains[i].get("maxDepth", 0))
    with ThreadPoolExecutor(parallelism or spark.sparkContext.defaultParallelism) as pool:
        scored = list(pool.map(lambda a: chain(*a), [(i, f) for i in order for f in range(num_folds)]))
    x.unpersist()
    auc = roc_auc(reduce(DataFrame.unionByName, scored), "_y", "score", ["chain", "maxIter", "_f"])
    means = auc.groupBy("chain", "maxIter").agg(F.avg("roc_auc").alias("score"))
    means = {(r["chain"], r["maxIter"]): r["score"] for r in means.collect()}  # a row a grid point
    release(*scored)
    return [{**c, **({"maxIter": n} if "maxIter" in grid else {}), "score": means.get((i, n))}
            for i, c in enumerate(chains) for n in stages]


def best_params(points: Sequence[Mapping]) -> dict:
    """The first grid point with the highest score (points without one, as their folds hold one class, come last)."""
    return dict(max(points, key=lambda p: -1.0 if p["score"] is None else p["score"]))


def refit(df: DataFrame, label: str, params: Mapping, features: str = "features",
          weight: str | None = None, refit_weighted: bool = False, seed: int = 0) -> GBTClassificationModel:
    """Refit the best point on all training rows.  As in the reference, the class
    weight is not used in the refit unless ``refit_weighted``."""
    p = {k: v for k, v in params.items() if k != "score"}
    return fit_boosted(df, label, features, weight if refit_weighted else None, seed, **p)


def predict(model, df: DataFrame, score: str = "score", pred: str = "prediction") -> DataFrame:
    """Hard label and positive-class probability."""
    out = model.transform(df)
    return (out.withColumn(score, vector_to_array(F.col(model.getProbabilityCol()))[1])
            .withColumn(pred, F.col(model.getPredictionCol()).cast("int")))


def evaluate_horizons(scored: DataFrame, group: str = "horizon", label: str = "label",
                      score: str = "score", pred: str = "prediction") -> dict[str, DataFrame]:
    """One long (horizon, label, score, prediction) frame, all metrics grouped by horizon."""
    g = [group]
    return {"roc_auc": roc_auc(scored, label, score, g),
            "average_precision": average_precision(scored, label, score, g),
            "report": classification_report(scored, label, pred, g)}


def split_count_importance(model, feature_names: Sequence[str], k: int | None = None,
                           path: str | None = None) -> DataFrame:
    """Number of splits per feature over all trees ("weight" importance), descending.

    Read from the saved model's node table, so it is a Spark job over the trees.
    """
    import uuid

    from cohortkit.session import checkpoint_dir

    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    path = path or f"{checkpoint_dir(spark).rstrip('/')}/model-{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    names = spark.createDataFrame(list(enumerate(feature_names)), "feature_index int, feature string")
    out = (nodes.select(F.col("nodeData.split.featureIndex").alias("feature_index"))
           .filter(F.col("feature_index") >= 0)
           .groupBy("feature_index").agg(F.count(F.lit(1)).alias("splits"))
           .join(F.broadcast(names), "feature_index", "left")
           .select("feature", "splits"))
    return top_k(out, "splits", k, ["feature"]) if k else out.orderBy(F.desc("splits"), "feature")
