import numpy as np
import pandas as pd

from cohortkit.plans.modelling import develop, odds_ratio, survival_study


def cohort(spark, n=240, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n)
    y = (x + 0.3 * rng.normal(size=n) > 0.3).astype(int)
    days = np.round(rng.exponential(10 * np.exp(-0.8 * x)), 2) + 0.1
    pdf = pd.DataFrame({
        "antibiotic_key": [f"k{i}" for i in range(n)],
        "mean_lab": np.where(rng.random(n) < 0.1, np.nan, x),   # some missing values to impute
        "admit_is_A": rng.integers(0, 2, n), "age_at_admin": rng.normal(60, 10, n),
        "cdiff_2d_flag": y, "cdiff_30d_flag": y,
        "cdiff_survival_flag": (rng.random(n) < 0.6).astype(int), "survival_time": days,
    })
    return spark.createDataFrame(pdf)


def test_develop_two_horizons(spark):
    t = cohort(spark)
    res = develop(t, ["mean_lab", "admit_is_A", "age_at_admin"], ["antibiotic_key"], horizons=(2, 30),
                  grid={"maxIter": [3], "maxDepth": [2]}, folds=2)
    auc = {r["horizon"]: r["roc_auc"] for r in res["metrics"]["roc_auc"].collect()}
    assert set(auc) == {"2d", "30d"} and min(auc.values()) > 0.75
    assert res["scored"].count() == 2 * 48  # ceil(0.2 * 240) test rows per horizon
    assert set(res["best"]) == {2, 30} and res["dropped"] == []


def test_a_feature_without_values_is_dropped_and_named(spark):
    from pyspark.sql import functions as F

    t = cohort(spark, n=120).withColumn("max_lab", F.lit(None).cast("double")).withColumn("min_lab", F.lit(float("nan")))
    for before in (True, False):
        res = develop(t, ["max_lab", "mean_lab", "min_lab"], ["antibiotic_key"], horizons=(30,),
                      grid={"maxIter": [2, 3], "maxDepth": [2]}, folds=2, impute_before_split=before)
        assert res["dropped"] == ["max_lab", "min_lab"] and res["models"][30].numFeatures == 1
        assert res["metrics"]["roc_auc"].first()["roc_auc"] > 0.7


def brute_cindex(t, e, s):
    num = den = 0.0
    for i in np.flatnonzero(e == 1):
        comp = (t > t[i]) | ((t == t[i]) & (e == 0))
        den += comp.sum()
        num += (s[comp] < s[i]).sum() + 0.5 * (s[comp] == s[i]).sum()
    return num / den


def test_survival_study_and_odds_ratio(spark):
    from cohortkit.operators import prep as PR
    from cohortkit.operators import survival as SV

    t = cohort(spark)
    res = survival_study(t, ["antibiotic_key"])
    m = res["model"]
    assert m["features"][0] == "mean_lab" and m["coef"][0] > 0  # higher value, earlier event
    assert res["km"].filter("survival < 0 or survival > 1").count() == 0
    # the reported concordance is that of the model's scores on the validation rows
    w = SV.survival_window(PR.normalise_missing(t), "survival_time", "cdiff_survival_flag", 0, 30)
    val = SV.cox_predict(m, PR.impute_median(PR.split_exact(w, ["antibiotic_key"], 0.2, seed=1), m["features"])
                         .filter("is_test = 1")).toPandas()
    ref = brute_cindex(val.survival_time.to_numpy(), val.cdiff_survival_flag.astype(int).to_numpy(),
                       val.risk_score.to_numpy())
    assert abs(res["cindex"].first()["cindex"] - ref) < 1e-12
    o = odds_ratio(t, "cdiff_30d_flag", "mean_lab").first()
    assert o["odds_ratio"] > 1


def test_registered_models_search_the_reference_grid(spark, monkeypatch):
    from cohortkit.operators import boosting as BO
    from cohortkit.plans import driver_tables

    asked = []

    def search(binned, targets, grid, num_folds):
        asked.append((targets, grid, num_folds))
        raise StopIteration

    monkeypatch.setattr(BO, "search", search)
    monkeypatch.setattr(driver_tables, "_cohort_with_keys", lambda *_: cohort(spark).selectExpr(
        "antibiotic_key as row_key", "mean_lab", "cdiff_2d_flag", "cdiff_30d_flag as cdiff_7d_flag", "cdiff_30d_flag"))
    for query, horizons in (("boosted_horizon_eval", 3), ("split_importance", 1)):
        try:
            driver_tables.SPARK[query](spark, None)
        except StopIteration:
            pass
        targets, grid, folds = asked.pop()
        assert targets == horizons and folds == 4
        assert grid == {"maxIter": [50, 70, 100, 150], "maxDepth": [3, 5, 7, 9], "stepSize": [0.1, 0.2]}
