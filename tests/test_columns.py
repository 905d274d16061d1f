import datetime as dt

from pyspark.sql import functions as F

from cohortkit.functions import columns as C


def test_flag_keeps_null(spark):
    df = spark.createDataFrame([(1,), (None,), (5,)], "x int")
    out = [r[0] for r in df.select(C.flag(F.col("x") > 2)).collect()]
    assert out == [0, None, 1]
    # the Spark default would have turned NULL into 0
    assert [r[0] for r in df.select(F.when(F.col("x") > 2, 1).otherwise(0)).collect()] == [0, 0, 1]


def test_paste_writes_na(spark):
    df = spark.createDataFrame([(1, None, "a")], "a long, b long, c string")
    assert df.select(C.paste("a", "b", "c")).first()[0] == "1_NA_a"


def test_pmax_keeps_null(spark):
    df = spark.createDataFrame([(-3.0,), (None,), (4.0,)], "x double")
    assert [r[0] for r in df.select(C.pmax("x", 0)).collect()] == [0.0, None, 4.0]


def test_add_days_exact_and_durations(spark):
    t0 = dt.datetime(2024, 3, 9, 12, 0, 0)
    df = spark.createDataFrame([(t0, t0 + dt.timedelta(days=2, hours=6))], "a timestamp, b timestamp")
    r = df.select(C.add_days("a", 1).alias("p"), C.days_between("a", "b").alias("d"),
                  C.hours_between("a", "b").alias("h"), C.years_between("a", "b").alias("y")).first()
    assert r["p"] == t0 + dt.timedelta(days=1)
    assert abs(r["d"] - 2.25) < 1e-12 and abs(r["h"] - 54) < 1e-9
    assert abs(r["y"] - 2.25 / 365) < 1e-12


def test_filter_range_drops_null_and_bounds(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (30.0,), (None,)], "x double")
    assert [r[0] for r in C.filter_range(df, "x", 0, 30).collect()] == [0.5]
    assert sorted(r[0] for r in C.filter_range(df, "x", 0, 30, "[]").collect()) == [0.0, 0.5, 30.0]


def test_nan_to_null_and_case(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert [r[0] for r in df.select(C.nan_to_null("x")).collect()] == [None, 1.0]
    m = df.select(C.map_codes(F.lit(2), {1: "a", 2: "b"}, "z")).first()[0]
    assert m == "b"


def test_lower_and_select_features(spark):
    df = spark.createDataFrame([(1, 2, 3)], "A int, admit_is_X int, mean_foo int")
    low = C.lower_columns(df)
    assert low.columns == ["a", "admit_is_x", "mean_foo"]
    assert C.select_features(low, ["_is_", "mean_"], ["a"]) == ["a", "admit_is_x", "mean_foo"]
