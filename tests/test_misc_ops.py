import datetime as dt

from pyspark.sql import functions as F

from cohortkit.functions import columns as C
from cohortkit.operators import joins as J
from cohortkit.operators import labels as L
from cohortkit.operators import pivots as PV
from cohortkit.operators import summaries as SM

T0 = dt.datetime(2024, 1, 1)
D = dt.timedelta(days=1)


def test_lookup_semi_filter_in_and_window_join(spark):
    rx = spark.createDataFrame([(1, "A"), (2, "B"), (3, "Z")], "id int, drug string")
    lk = spark.createDataFrame([("A", "c1"), ("B", "c2")], "Antibiotic string, cls string")
    out = {r["id"]: r["cls"] for r in J.lookup_join(rx, lk, {"drug": "Antibiotic"}).collect()}
    assert out == {1: "c1", 2: "c2", 3: None}
    assert sorted(r["id"] for r in J.semi_join(rx, lk, {"drug": "Antibiotic"}).collect()) == [1, 2]
    assert sorted(r["id"] for r in C.filter_in(rx, "drug", lk.select("Antibiotic")).collect()) == [1, 2]
    assert sorted(r["id"] for r in C.filter_in(rx, "drug", ["Z"]).collect()) == [3]
    idx = spark.createDataFrame([(1, T0)], "k int, t0 timestamp")
    ev = spark.createDataFrame([(1, T0 + D), (1, T0 + 3 * D), (1, T0 - D)], "k int, t timestamp")
    w = J.window_join(idx, ev, ["k"], "t", "t0", 1, 2).orderBy("t").collect()
    assert [r["in_window"] for r in w] == [0, 1, 0]


def test_earliest_multiplicity(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    b = spark.createDataFrame([(1, T0 + D), (1, T0), (2, T0)], "k int, t timestamp")
    assert J.enrich(a, b, ["k"]).count() == 3
    e = {r["k"]: r["t"] for r in J.enrich(a, b, ["k"], multiplicity="earliest", order=["t"]).collect()}
    assert e == {1: T0, 2: T0}


def test_wide_pivot_and_one_hot_unused(spark):
    df = spark.createDataFrame([(1, "x", 1.0, 2.0), (1, "y", 3.0, 4.0), (2, "x", 5.0, 6.0)],
                               "id int, t string, a double, b double")
    w = {r["id"]: r for r in PV.wide_pivot(df, ["id"], "t", ["x", "y", "z"], ["a", "b"]).collect()}
    assert w[1]["a_y"] == 3.0 and w[2]["b_y"] is None and w[1]["a_z"] is None
    # Listed value with no rows gets a 0 column, or is dropped with drop_unused
    oh = PV.one_hot_pivot(df, ["id"], "t", ["x", "y", "z"], prefix="is_")
    assert {r["id"]: (r["is_x"], r["is_y"], r["is_z"]) for r in oh.collect()} == {1: (1, 1, 0), 2: (1, 0, 0)}
    assert "is_z" not in PV.one_hot_pivot(df, ["id"], "t", ["x", "y", "z"], prefix="is_", drop_unused=True).columns


def test_counts_balance_rate_profile(spark):
    df = spark.createDataFrame([(1, "a"), (0, "a"), (0, "b"), (0, "b")], "y int, g string")
    assert [(r["y"], r["n"]) for r in SM.count_by(df, "y").collect()] == [(0, 3), (1, 1)]
    cb = SM.class_balance(df, "y").first()
    assert (cb["negatives"], cb["positives"], cb["ratio"]) == (3, 1, 3.0)
    rates = {r["g"]: r["case_rate"] for r in SM.case_rate(df, "y", ["g"]).collect()}
    assert rates == {"a": 0.5, "b": 0.0}
    prof = {r["type"]: (r["n_columns"], r["n_values"]) for r in SM.schema_profile(df).collect()}
    assert prof == {"int": (1, 4), "string": (1, 4)}
    some = spark.createDataFrame([(1, None, "x"), (None, 2, "y")], "a int, b int, s string")
    assert {tuple(r) for r in SM.schema_profile(some).collect()} == {("int", 2, 2), ("string", 1, 2)}
    none = spark.createDataFrame([(0,)], "y int")
    assert SM.class_balance(none, "y").first()["ratio"] is None


def test_composite_label(spark):
    df = spark.createDataFrame([(1, T0, T0 + 2 * D, "C"), (2, T0, T0 + 2 * D, None), (3, T0, None, "C")],
                               "id int, t0 timestamp, test_ts timestamp, code string")
    got = {r["id"]: r["composite_30d"] for r in L.composite_label(df, "test_ts", "t0", "code", "C").collect()}
    assert got == {1: 1, 2: 0, 3: 0}
    assert F


def test_cast_preview_shape_struct(spark):
    from cohortkit.operators.survival import as_structured

    df = spark.createDataFrame([(1, 2.5), (0, 3.0)], "cdiff_survival_flag int, survival_time double")
    assert dict(C.cast_columns(df, {"cdiff_survival_flag": "boolean"}).dtypes)["cdiff_survival_flag"] == "boolean"
    assert C.preview(df, 1).count() == 1 and C.shape(df) == (2, 2)
    y = as_structured(df).select("y.status", "y.survival_in_days").collect()
    assert (y[0][0], y[0][1]) == (True, 2.5)


def test_merge_within_matches_sequential_rule(spark):
    import numpy as np

    from cohortkit.operators.sessions import merge_within

    rng = np.random.default_rng(8)
    rows = []
    for k in range(3):
        n = 200 if k == 0 else 15  # one hot key
        ts = sorted(T0 + dt.timedelta(minutes=int(m)) for m in rng.integers(0, 60 * 48, n))
        rows += [(k, t, k * 1000 + i) for i, t in enumerate(ts)]
    rows.append((1, T0 + dt.timedelta(hours=100), 5000))
    rows.append((1, T0 + dt.timedelta(hours=101), 5001))  # exactly one gap later: a new session
    df = spark.createDataFrame(rows, "k int, t timestamp, o long")
    got = sorted((r["k"], r["first_order"], r["n_events"]) for r in merge_within(df, "k", "t", "o").collect())
    ref = []
    for k in range(3):
        rs = sorted((t, o) for kk, t, o in rows if kk == k)
        cur = None
        for t, o in rs:
            if cur is None or (t - prev) >= dt.timedelta(hours=1):
                if cur:
                    ref.append((k, min(cur), len(cur)))
                cur = []
            cur.append(o)
            prev = t
        ref.append((k, min(cur), len(cur)))
    assert got == sorted(ref)
