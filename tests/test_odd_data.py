"""NULL, NaN, infinite and tied values, 64-bit ids and one-class groups."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from cohortkit.operators import history, metrics, prep, quantiles, sessions, summaries, survival
from cohortkit.sources import io

BIG = 2**53 + 1


@pytest.mark.parametrize("chunk_rows", [200_000, 2])
def test_history_keeps_64_bit_ids(spark, chunk_rows):
    t = dt.datetime(2020, 1, 1)
    m = spark.createDataFrame(
        [(k, "a", t + dt.timedelta(hours=h), float(h), h) for k in (BIG, None) for h in range(5)],
        "k long, test string, ts timestamp_ntz, v double, o long")
    ix = spark.createDataFrame([(BIG, BIG + 2, t + dt.timedelta(hours=3)), (None, BIG + 4, t + dt.timedelta(hours=9))],
                               "k long, i long, at timestamp_ntz")
    got = history.history_stats(m, ix, ["k"], test_col="test", time_col="ts", value_col="v", order_col="o",
                                index_id="i", index_time="at", tests=["a"], chunk_rows=chunk_rows).collect()
    assert sorted((r["i"], r["count"], r["last"]) for r in got) == [(BIG + 2, 3, 2.0), (BIG + 4, 5, 4.0)]
    assert {r["i"]: r["k"] for r in got} == {BIG + 2: BIG, BIG + 4: None}


def _scored(spark):
    rows = [("x", 1, 0.9), ("x", 0, 0.1), ("neg", 0, 0.5), ("neg", 0, 0.6), (None, 1, 0.8), (None, 0, 0.2),
            ("x", 1, None), ("x", None, 0.4)]
    return spark.createDataFrame(rows, "g string, y int, s double")


def test_metrics_with_one_class_null_group_and_null_scores(spark):
    d = _scored(spark)
    assert {r["g"]: r["roc_auc"] for r in metrics.roc_auc(d, "y", "s", ["g"]).collect()} == {"x": 1.0, None: 1.0, "neg": None}
    ap = {r["g"]: r["average_precision"] for r in metrics.average_precision(d, "y", "s", ["g"]).collect()}
    assert ap == {"x": 1.0, None: 1.0, "neg": None}
    assert metrics.roc_curve(d, "y", "s", ["g"]).filter("g = 'neg' and tpr is not null").isEmpty()
    assert metrics.pr_curve(d, "y", "s", ["g"]).count() == 6


def test_kaplan_meier_drops_null_times_and_keeps_a_null_group(spark):
    rows = [("a", 1.0, 1), ("a", 2.0, 0), ("a", None, 1), ("a", 3.0, None), (None, 1.0, 1), (None, 2.0, 0)]
    d = spark.createDataFrame(rows, "g string, t double, e int")
    got = sorted(((r["g"] or "", r["time"], r["n_at_risk"], round(r["survival"], 6)) for r in
                  survival.kaplan_meier(d, "t", "e", ["g"]).collect()))
    assert got == [(g, t, n, 0.5) for g in ("", "a") for t, n in ((1.0, 2), (2.0, 1))]


def test_sessions_of_a_null_key(spark):
    t = dt.datetime(2020, 1, 1)
    d = spark.createDataFrame([(None, t + dt.timedelta(minutes=50 * i), i) for i in range(4)], "k long, ts timestamp_ntz, o long")
    r = sessions.merge_within(d, "k", "ts", "o").collect()
    assert [(x["session"], x["n_events"]) for x in r] == [(1, 4)]


def test_folds_keep_null_labels(spark):
    d = spark.range(400).selectExpr("id", "if(id % 4 = 0, null, int(id % 3 = 0)) as y")
    f = prep.stratified_folds(d, ["id"], "y").groupBy("y", "fold").count().collect()
    assert sum(r["count"] for r in f) == 400
    for y in {r["y"] for r in f}:
        n = [r["count"] for r in f if r["y"] == y]
        assert len(n) == 4 and max(n) - min(n) <= 1


def test_split_ends_with_repeated_keys(spark):
    d = spark.range(100).selectExpr("if(id < 60, 'same', string(id)) as k").withColumn("h", F.md5("k"))
    want = sorted(r["h"] for r in d.collect())
    for k in (1, 30, 80):
        assert prep.kth_hash(d, "h", k) == want[k - 1]


@pytest.mark.parametrize("values", [
    [float("inf"), float("-inf"), *range(1000)], [10.0 ** i for i in range(300)] * 3, [1.7e308, -1.7e308, 0.0] * 300,
    [1.0, 1.0 + 2**-52] * 400])
def test_quantiles_of_odd_values(spark, values):
    d = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = quantiles.exact_quantiles(d, ["x"], [0.0, 0.25, 0.5, 1.0], values_per_chunk=40)["x"]
    s = sorted(map(float, values))
    for p, g in zip([0.0, 0.25, 0.5, 1.0], got):
        h = (len(s) - 1) * p
        a, b = s[math.floor(h)], s[math.ceil(h)]
        assert g == (a if a == b else a + (h - math.floor(h)) * (b - a))


def test_summaries_in_one_chunk_and_many_agree(spark):
    rows = [(1e10, float(i), i) for i in range(999)] + [(1e10, float("nan"), 999), (1e-5, 1.0, 1), (None, 2.0, 2)]
    d = spark.createDataFrame(rows, "k double, v double, o long")
    cold, hot = ({r["k"]: (r["median"], r["count"]) for r in summaries.summarise(
        d, ["k"], "v", ["o"], ["median", "count"], values_per_chunk=n).collect()} for n in (50_000, 100))
    assert cold == hot and cold[1e10] == (499.5, 1000)


def test_csv_dialect(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text('ID,DRUG,DOSE\n1,"5% Dextrose ""IV"", bag",2.5\n2,NA,NA\n3,,1\n')
    rows = [(1, '5% Dextrose "IV", bag', 2.5), (2, None, None), (3, None, 1.0)]
    assert [tuple(r) for r in io.read_table(spark, str(p)).collect()] == rows
    assert [tuple(r) for r in io.read_table(spark, str(p), "ID long, DRUG string, DOSE double").collect()] == rows
    p.write_text("ID,DRUG,DOSE\n1,a,2.5\nb,2,x\n")
    with pytest.raises(Exception):
        io.read_table(spark, str(p), "ID long, DRUG string, DOSE double").collect()
