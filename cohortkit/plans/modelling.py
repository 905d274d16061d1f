"""Model development and evaluation on a cohort table (the reference's second
and third entry points): impute, split, tune per horizon, refit, score the
held-out rows, and evaluate all horizons in one grouped pass; survival model
on the 30-day window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortkit.functions.columns import select_features
from cohortkit.operators import boosting as BO
from cohortkit.operators import model as MD
from cohortkit.operators import prep as PR
from cohortkit.operators import survival as SV
from cohortkit.operators.labels import HORIZONS
from cohortkit.session import materialize, release


def develop(table: DataFrame, features: Sequence[str], key_cols: Sequence[str], *,
            horizons: Sequence[int] = HORIZONS, label: str = "cdiff_{h}d_flag",
            grid: Mapping[str, Sequence] = MD.REFERENCE_GRID, folds: int = 4, test_frac: float = 0.2,
            seed: int = 0, impute: str = "features", impute_before_split: bool = True,
            refit_weighted: bool = False) -> dict:
    """Tune, refit and score one boosted-tree model per horizon; all fits of all horizons grow in the same passes.

    Returns {"scored": long (horizon, label, score, prediction) frame of the
    test rows, "best": {horizon: params}, "models": {horizon: model},
    "metrics": grouped metric frames, "dropped": features without any value
    in the rows that medians are taken from, which no model uses}.
    ``impute='features'`` fills only feature columns (recommended); ``'all'``
    fills every numeric column as the reference does.
    """
    feats = list(features)
    labels = [label.format(h=h) for h in horizons]
    num_cols = feats if impute == "features" else [c for c, t in table.dtypes if t in ("double", "int", "bigint")
                                                   and c not in key_cols]
    t = PR.split_exact(materialize(PR.normalise_missing(table), "cohort"), key_cols, test_frac, seed=seed)
    med = PR.median_values(t if impute_before_split else t.filter("is_test = 0"), num_cols)
    t = PR.impute_median(t, num_cols, medians=med)
    dropped = [c for c in feats if c in med and med[c] is None]
    feats = [c for c in feats if c not in dropped]
    t = materialize(PR.assemble(t, feats), "modelling-input")  # reused by every fit below
    train, test = t.filter("is_test = 0"), t.filter("is_test = 1")
    rows, scored = train, []
    for y in labels:  # folds and weights of every horizon, beside each other
        rows = PR.class_weights(rows, y, name=f"_w_{y}")
        rows = PR.stratified_folds(rows, key_cols, y, k=folds, seed=seed, name=f"_f_{y}")
    binned = BO.bin_rows(rows, [(y, f"_w_{y}", f"_f_{y}") for y in labels])
    chosen = [MD.best_params(points) for points in BO.search(binned, len(labels), grid, folds)]
    best = dict(zip(horizons, chosen))
    models = dict(zip(horizons, BO.refit(binned, chosen, refit_weighted)))
    release(binned.blocks)
    for h, y in zip(horizons, labels):
        p = BO.predict(models[h], test)
        scored.append(p.select(F.lit(f"{h}d").alias("horizon"), F.col(y).cast("int").alias("label"),
                               "score", "prediction"))
    long = scored[0]
    for s in scored[1:]:
        long = long.unionByName(s)
    return {"scored": long, "best": best, "models": models, "metrics": MD.evaluate_horizons(long),
            "dropped": dropped}


SURVIVAL_EXTRA = ("admin_time_since_admission", "admission_time_of_day", "age_at_admin")


def survival_study(table: DataFrame, key_cols: Sequence[str], *, time: str = "survival_time",
                   event: str = "cdiff_survival_flag", horizon: float = 30, val_frac: float = 0.2,
                   seed: int = 1, patterns: Sequence[str] = ("_is_", "mean_")) -> dict:
    """Window (0, horizon), features by name pattern, split, Kaplan-Meier on the
    validation part, Cox fit on standardised features, concordance, hazard ratios."""
    w = materialize(SV.survival_window(PR.normalise_missing(table), time, event, 0, horizon), "survival-window")
    feats = [c for c in select_features(w, patterns, SURVIVAL_EXTRA) if c not in (time, event)]
    # constant columns make the Cox Hessian singular: keep features that vary
    sd = w.agg(*[F.stddev_pop(c).alias(c) for c in feats]).collect()[0]
    feats = [c for c in feats if sd[c]]
    s = PR.split_exact(w, key_cols, val_frac, seed=seed)
    s = materialize(PR.impute_median(s, feats), "survival-split")
    train, val = s.filter("is_test = 0"), s.filter("is_test = 1")
    km = SV.kaplan_meier(val, time, event)
    model = SV.fit_cox(train, feats, time, event, standardize=True)
    cidx = SV.concordance_index(SV.cox_predict(model, val), time, event, "risk_score")
    return {"km": km, "model": model, "cindex": cidx, "hazard_ratios": SV.hazard_ratios(table.sparkSession, model)}


def odds_ratio(df: DataFrame, label: str, x: str) -> DataFrame:
    """Logistic regression of ``label`` on one column; odds ratio per unit of ``x``."""
    d = PR.assemble(df.select(F.col(label).cast("double").alias("label"), F.col(x).cast("double").alias(x))
                    .dropna(), [x])
    m = LogisticRegression(featuresCol="features", labelCol="label", regParam=0.0, tol=1e-10, maxIter=200).fit(d)
    coef = float(m.coefficients[0])
    spark = df.sparkSession
    return spark.createDataFrame([(x, coef, float(m.intercept))], "feature string, coef double, intercept double") \
        .withColumn("odds_ratio", F.exp("coef"))
