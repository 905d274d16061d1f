import datetime as dt
import gzip
import os

import numpy as np
import pandas as pd
from pyspark.sql import types as T

from cohortkit.operators import model as MD
from cohortkit.operators import prep as PR
from cohortkit.operators.distribution import bw_nrd0, histogram, kde
from cohortkit.operators.pivots import unpivot_long
from cohortkit.sources import io


def test_csv_gzip_roundtrip_with_schema_and_case(spark, tmp_path):
    p = tmp_path / "labs.csv.gz"
    with gzip.open(p, "wt") as f:
        f.write("ROW_ID,SUBJECT_ID,CHARTTIME,VALUENUM\n1,7,2024-01-01 10:00:00,1.5\n2,7,2024-01-02 11:00:00,\n")
    schema = T.StructType([T.StructField("ROW_ID", T.LongType()), T.StructField("SUBJECT_ID", T.LongType()),
                           T.StructField("CHARTTIME", T.TimestampType()), T.StructField("VALUENUM", T.DoubleType())])
    df = io.read_table(spark, str(p), schema=schema)
    assert df.columns == ["row_id", "subject_id", "charttime", "valuenum"]
    rows = df.orderBy("row_id").collect()
    assert rows[0]["charttime"] == dt.datetime(2024, 1, 1, 10) and rows[1]["valuenum"] is None
    sub = io.read_table(spark, str(p), schema=schema, columns=["row_id"])
    assert sub.columns == ["row_id"]
    out = tmp_path / "out"
    io.write_table(df, str(out), fmt="csv", compression="gzip", row_id="idx", order_by=["row_id"])
    parts = [x for x in os.listdir(out) if x.endswith(".csv.gz")]
    assert parts
    back = spark.read.option("header", True).csv(str(out))
    assert sorted(int(r["idx"]) for r in back.collect()) == [0, 1]
    io.write_table(df, str(tmp_path / "pq"))
    assert io.read_table(spark, str(tmp_path / "pq")).count() == 2


def test_lookup_broadcast_bound(spark, tmp_path):
    p = tmp_path / "lk.csv"
    p.write_text("Antibiotic,drug_class\nA,X\nB,Y\n")
    lk = io.load_lookup(spark, str(p))
    assert lk.count() == 2
    big = spark.range(0, 50)
    assert io.broadcast_if_small(big, max_rows=10) is big  # over the bound: no hint


def test_row_index_is_dense_and_ordered(spark):
    df = spark.createDataFrame([(i, float(-i)) for i in range(100)], "k int, v double").repartition(7)
    out = io.with_row_index(df, "idx", ["v"]).toPandas().sort_values("idx")
    assert list(out["idx"]) == list(range(100)) and list(out["k"]) == list(range(99, -1, -1))


def _separable(spark, n=300, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] > 0).astype(int)
    pdf = pd.DataFrame({"id": np.arange(n), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y})
    return PR.assemble(spark.createDataFrame(pdf), ["a", "b", "c"])


def test_boosted_fit_grid_refit_predict_importance(spark, tmp_path):
    from cohortkit.operators.metrics import roc_auc

    df = _separable(spark)
    f = PR.stratified_folds(PR.class_weights(df, "y"), ["id"], "y", k=2, seed=0)
    points = MD.grid_search(f, "y", {"maxIter": [3, 6], "maxDepth": [2]}, "fold", weight="weight", parallelism=2)
    best = MD.best_params(points)
    assert [p["maxIter"] for p in points] == [3, 6] and best["score"] == max(p["score"] for p in points)
    assert best["maxIter"] in (3, 6) and 0.5 < best["score"] <= 1.0
    m = MD.refit(f, "y", best)
    scored = MD.predict(m, df)
    auc = roc_auc(scored, "y", "score").first()[0]
    assert auc > 0.95
    imp = MD.split_count_importance(m, ["a", "b", "c"], k=2, path=str(tmp_path / "m")).toPandas()
    assert imp["feature"].iloc[0] in ("a", "b") and len(imp) <= 2 and (imp["splits"] > 0).all()
    io.save_model(m, str(tmp_path / "saved"))
    from pyspark.ml.classification import GBTClassificationModel

    m2 = io.load_model(str(tmp_path / "saved"), GBTClassificationModel)
    a = MD.predict(m2, df).select("score").toPandas()["score"]
    assert np.allclose(a, scored.select("score").toPandas()["score"])
    long = scored.withColumn("horizon", scored["id"] % 2).withColumn("label", scored["y"])
    ev = MD.evaluate_horizons(long)
    assert ev["roc_auc"].count() == 2 and ev["report"].count() == 10


def test_stages_of_a_chain_equal_separate_fits(spark):
    """Scores after n trees of a long fit, and the grid's AUCs, are those of fits of n trees."""
    from cohortkit.operators.metrics import roc_auc

    rng = np.random.default_rng(9)
    n = 400
    pdf = pd.DataFrame(rng.normal(size=(n, 3)), columns=["a", "b", "c"]).assign(id=range(n))
    pdf["y"] = (pdf.a + pdf.b * pdf.c + rng.normal(size=n) > 0).astype(int)
    df = PR.assemble(spark.createDataFrame(pdf), ["a", "b", "c"])
    f = PR.stratified_folds(PR.class_weights(df, "y"), ["id"], "y", k=2, seed=0).cache()
    stages = [2, 5, 9]
    for depth, step in ((2, 0.1), (4, 0.2)):
        chain = MD.fit_boosted(f, "y", weight="weight", maxIter=9, maxDepth=depth, stepSize=step)
        got = MD.staged_scores(chain, f, stages).orderBy("id").toPandas()
        for k in stages:
            alone = MD.predict(MD.fit_boosted(f, "y", weight="weight", maxIter=k, maxDepth=depth, stepSize=step), f)
            assert np.abs(alone.orderBy("id").toPandas()["score"] - got[f"score_{k}"]).max() < 1e-12
    points = MD.grid_search(f, "y", {"maxIter": stages, "maxDepth": [2, 4]}, "fold", weight="weight")
    assert [(p["maxDepth"], p["maxIter"]) for p in points] == [(d, k) for d in (2, 4) for k in stages]
    for p in points:
        aucs = []
        for fold in (0, 1):
            m = MD.fit_boosted(f.filter(f["fold"] != fold), "y", weight="weight", maxIter=p["maxIter"], maxDepth=p["maxDepth"])
            aucs.append(roc_auc(MD.predict(m, f.filter(f["fold"] == fold)), "y", "score").first()[0])
        assert abs(p["score"] - np.mean(aucs)) < 1e-9


def test_histogram_and_kde(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=2000)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "g": (x > 0).astype(int)}))
    h = histogram(df, "x", -1.0, 1.0, 4).toPandas().set_index("bin")["n"]
    ref = np.histogram(x[(x >= -1) & (x <= 1)], bins=4, range=(-1, 1))[0]
    assert list(h.sort_index()) == list(ref)
    dens = kde(df, "x").toPandas()
    grid = dens["x"].to_numpy()
    q75, q25 = np.quantile(x, [0.75, 0.25])
    bw = bw_nrd0(len(x), x.std(ddof=1), q75 - q25)
    exact = np.exp(-0.5 * ((grid[:, None] - x[None, :]) / bw) ** 2).sum(1) / (len(x) * bw * np.sqrt(2 * np.pi))
    assert np.max(np.abs(dens["density"].to_numpy() - exact)) < 5e-3  # linear binning approximation
    assert abs(np.trapezoid(dens["density"], grid) - 1) < 1e-2
    assert set(kde(df, "x", "g").toPandas()["group"]) == {"0", "1"}
    low = kde(df, "x", log10=True, floor=1.0).toPandas()  # nothing falls out at zero or less
    assert abs(np.trapezoid(low["density"], low["x"]) - 1) < 2e-2


def test_unpivot_long(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "id int, a double, b double")
    out = unpivot_long(df, ["id"], ["a", "b"]).collect()
    assert sorted((r["variable"], r["value"]) for r in out) == [("a", 2.0), ("b", 3.0)]


def test_stage_gzip_csv_as_parquet(spark, tmp_path):
    p = tmp_path / "rx.csv.gz"
    with gzip.open(p, "wt") as f:
        f.write("ROW_ID,DRUG\n" + "".join(f"{i},d{i % 3}\n" for i in range(50)))
    out = io.stage_as_parquet(spark, str(p), str(tmp_path / "rx_pq"), num_partitions=4)
    assert out.count() == 50 and out.columns == ["row_id", "drug"]
    assert out.rdd.getNumPartitions() >= 1 and any(x.endswith(".parquet") for x in os.listdir(tmp_path / "rx_pq"))
