import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortkit.operators import prep as PR
from cohortkit.operators.quantiles import exact_quantiles


@pytest.mark.parametrize("chunk", [50_000, 40, 7])
def test_exact_quantiles_match_numpy(spark, chunk):
    rng = np.random.default_rng(3)
    a = rng.normal(size=500)
    b = np.round(rng.exponential(size=500), 1)  # many ties
    c = np.full(500, np.nan)
    pdf = pd.DataFrame({"a": a, "b": b, "c": c})
    pdf.loc[::7, "a"] = np.nan
    df = spark.createDataFrame(pdf)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = exact_quantiles(df, ["a", "b", "c"], probs, values_per_chunk=chunk)
    for col in ("a", "b"):
        ref = np.quantile(pdf[col].dropna().to_numpy(), probs)
        np.testing.assert_allclose(got[col], ref, rtol=0, atol=1e-12)
    assert got["c"] == [None] * len(probs)


def test_impute_median_and_mean(spark):
    # All-null column, no-null column, even and odd counts
    df = spark.createDataFrame([(1, 1.0, None, 5.0), (2, None, None, 1.0), (3, 4.0, None, 3.0), (4, 10.0, None, 2.0)],
                               "id int, x double, allnull double, full double")
    med = {r["id"]: r for r in PR.impute_median(df, ["x", "allnull", "full"]).collect()}
    assert med[2]["x"] == 4.0 and med[2]["allnull"] is None and med[2]["full"] == 1.0
    with pytest.raises(ValueError):
        PR.impute_median(df, ["allnull"], all_null="error")
    mean = {r["id"]: r for r in PR.impute_mean(df, ["x"]).collect()}
    assert mean[2]["x"] == 5.0
    # fit on one frame, apply to another
    fitted = PR.median_values(df.filter("id <= 3"), ["x"])
    assert PR.impute_median(df, ["x"], medians=fitted).filter("id = 2").first()["x"] == 2.5


def test_split_exact_and_kth_hash(spark):
    df = spark.range(0, 1003).withColumnRenamed("id", "k")
    s = PR.split_exact(df, ["k"], 0.2, seed=5)
    assert s.filter("is_test = 1").count() == 201  # ceil(0.2 * 1003)
    s2 = PR.split_exact(df, ["k"], 0.2, seed=5)
    assert s.filter("is_test = 1").select("k").orderBy("k").collect() == \
        s2.filter("is_test = 1").select("k").orderBy("k").collect()
    h = df.withColumn("h", PR.hash_rank_key(["k"], 5))
    ref = sorted(r[0] for r in h.select("h").collect())
    for k in (1, 17, 500, 1003):
        assert PR.kth_hash(h, "h", k) == ref[k - 1]


def test_stratified_folds_keep_ratio(spark):
    rows = [(i, 1 if i % 5 == 0 else 0) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, y int")
    f = PR.stratified_folds(df, ["id"], "y", k=4, seed=1).toPandas()
    counts = f.groupby(["fold", "y"]).size().unstack()
    assert (counts[1] == 20).all() and (counts[0] == 80).all()


def test_weights_standardise_assemble(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (0, 3.0), (1, 4.0)], "y int, x double")
    w = [r["weight"] for r in PR.class_weights(df, "y").orderBy("x").collect()]
    assert w == [1.0, 1.0, 1.0, 3.0]
    z = np.array([r["x"] for r in PR.standardise(df, ["x"]).orderBy("x").collect()])
    np.testing.assert_allclose(z, (np.arange(1, 5) - 2.5) / np.std(np.arange(1, 5)))
    v = PR.assemble(df, ["x", "y"]).first()["features"]
    assert list(v) == [1.0, 0.0]
    nan = spark.createDataFrame([(float("nan"),)], "x double")
    assert PR.normalise_missing(nan).first()["x"] is None
    assert F


def test_summarise_in_many_chunks_equals_one(spark):
    from cohortkit.operators.summaries import summarise

    rng = np.random.default_rng(9)
    rows = [(0 if i < 600 else int(rng.integers(1, 20)), float(rng.integers(0, 50)), i) for i in range(900)]
    df = spark.createDataFrame(rows, "k int, v double, o int")
    a = summarise(df, ["k"], "v", ["o"], quantiles=[0.9]).toPandas().set_index("k").sort_index()
    b = summarise(df, ["k"], "v", ["o"], quantiles=[0.9], values_per_chunk=9).toPandas().set_index("k").sort_index()
    pd.testing.assert_frame_equal(a, b[a.columns], check_exact=False, rtol=1e-12)
    ref = pd.DataFrame(rows, columns=["k", "v", "o"])
    g = ref[ref.k == 0]["v"].to_numpy()
    assert abs(b.loc[0, "median"] - np.median(g)) < 1e-12
    assert abs(b.loc[0, "iqr"] - (np.quantile(g, .75) - np.quantile(g, .25))) < 1e-12
