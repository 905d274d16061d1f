import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortkit.operators import survival as SV


def km_ref(t, e):
    out = []
    s = 1.0
    gw = 0.0
    for u in np.unique(t):
        n = (t >= u).sum()
        d = ((t == u) & (e == 1)).sum()
        s *= 1 - d / n
        if n > d:
            gw += d / (n * (n - d))
        out.append((u, n, d, s, gw))
    return out


def test_kaplan_meier_matches_product_limit(spark):
    # Tied times, event and censoring at the same time, last row an event (S reaches 0)
    t = np.array([1, 1, 2, 2, 2, 3, 5, 5, 8, 9.0])
    e = np.array([1, 0, 1, 1, 0, 0, 1, 0, 1, 1])
    df = spark.createDataFrame(pd.DataFrame({"t": t, "e": e}))
    got = SV.kaplan_meier(df, "t", "e").toPandas().sort_values("time").reset_index(drop=True)
    ref = km_ref(t, e)
    assert len(got) == len(ref)
    for (u, n, d, s, gw), (_, row) in zip(ref, got.iterrows()):
        assert row["time"] == u and row["n_at_risk"] == n and row["n_events"] == d
        assert abs(row["survival"] - s) < 1e-12
        if 0 < s < 1:
            z = SV.Z_95
            lo = np.exp(np.exp(-z * np.sqrt(gw) / np.log(s)) * np.log(s))
            assert abs(row["ci_lower"] - lo) < 1e-9 and row["ci_lower"] <= s <= row["ci_upper"]
    assert got["survival"].iloc[-1] == 0.0 and got["ci_upper"].iloc[-1] == 0.0


@pytest.mark.parametrize("n_chunks", [1, 4, 17])
@pytest.mark.parametrize("times,scores", [(20, 15), (3, 2), (1, 40), (40, 1), (10 ** 6, 10 ** 6)])
def test_concordance_brute_force(spark, n_chunks, times, scores):
    """Day-like times, one time or one score that spans every chunk, and no ties at all."""
    rng = np.random.default_rng(11)
    n = 250
    t = rng.integers(0, times, n).astype(float)
    s = rng.integers(0, scores, n).astype(float)
    e = rng.integers(0, 2, n)
    df = spark.createDataFrame(pd.DataFrame({"t": t, "s": s, "e": e}))
    num = ties = den = 0
    for i in np.flatnonzero(e == 1):
        comp = (t > t[i]) | ((t == t[i]) & (e == 0))
        den += comp.sum()
        num += (s[comp] < s[i]).sum()
        ties += (s[comp] == s[i]).sum()
    got = SV.concordance_index(df, "t", "e", "s", n_chunks=n_chunks).first()
    assert (got["comparable"], got["concordant"], got["tied_risk"]) == (den, num, ties)
    assert got["cindex"] == (num + 0.5 * ties) / den if den else got["cindex"] is None


def test_inversions():
    rng = np.random.default_rng(12)
    for n in (0, 1, 2, 7, 64, 129):
        order, key = rng.permutation(n), rng.integers(0, 9, n)
        w, e = rng.integers(1, 5, n), rng.integers(0, 3, n)
        want = sum(int(e[i]) * int(w[(order < order[i]) & (key > key[i])].sum()) for i in range(n))
        assert SV._inversions(order, key, w, e) == want


def cox_newton(X, t, e, iters=50):
    b = np.zeros(X.shape[1])
    for _ in range(iters):
        eta = X @ b
        w = np.exp(eta)
        g = np.zeros_like(b)
        H = np.zeros((len(b), len(b)))
        for u in np.unique(t[e == 1]):
            risk = t >= u
            d = ((t == u) & (e == 1))
            r0 = w[risk].sum()
            r1 = (w[risk, None] * X[risk]).sum(0)
            r2 = (w[risk, None, None] * X[risk, :, None] * X[risk, None, :]).sum(0)
            g += X[d].sum(0) - d.sum() * r1 / r0
            H += d.sum() * (r2 / r0 - np.outer(r1, r1) / r0 ** 2)
        step = np.linalg.solve(H, g)
        b = b + step
        if np.abs(step).max() < 1e-12:
            break
    return b


def test_cox_matches_numpy_newton(spark):
    rng = np.random.default_rng(5)
    n = 200
    X = rng.normal(size=(n, 3))
    t = np.round(rng.exponential(np.exp(-X @ np.array([0.5, -0.3, 0.0]))), 1) + 0.1  # ties (Breslow)
    e = rng.integers(0, 2, n) | (rng.random(n) < 0.5)
    pdf = pd.DataFrame({"x0": X[:, 0], "x1": X[:, 1], "x2": X[:, 2], "t": t, "e": e.astype(int)})
    df = spark.createDataFrame(pdf)
    m = SV.fit_cox(df, ["x0", "x1", "x2"], "t", "e")
    ref = cox_newton(X, t, e.astype(int))
    np.testing.assert_allclose(m["coef"], ref, atol=1e-6)
    hr = SV.hazard_ratios(spark, m).toPandas()
    assert hr["hazard_ratio"].is_monotonic_decreasing
    scored = SV.cox_predict(m, df).toPandas()
    np.testing.assert_allclose(scored["risk_score"], X @ np.array(m["coef"]), atol=1e-9)
    w = SV.survival_window(df, "t", "e", 0, 1.0)
    assert w.filter("t >= 1.0 or t <= 0").count() == 0 and dict(w.dtypes)["e"] == "boolean"


def test_cox_save_load_with_scaling(spark, tmp_path):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"x": rng.normal(5, 2, 100), "t": rng.exponential(size=100) + 0.01,
                        "e": rng.integers(0, 2, 100)})
    df = spark.createDataFrame(pdf)
    m = SV.fit_cox(df, ["x"], "t", "e", standardize=True)
    SV.save_cox(spark, m, str(tmp_path / "cox"))
    m2 = SV.load_cox(spark, str(tmp_path / "cox"))
    a = SV.cox_predict(m, df).select("risk_score").toPandas()["risk_score"]
    b = SV.cox_predict(m2, df).select("risk_score").toPandas()["risk_score"]
    np.testing.assert_allclose(a, b, atol=1e-12)


def test_cox_large_predictors_and_missing_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=120)
    t = np.ceil(rng.exponential(np.exp(-x)) * 20)
    rows = [(float(a), float(b), int(i % 4 > 0)) for i, (a, b) in enumerate(zip(x, t))]
    df = spark.createDataFrame(rows + [(None, 1.0, 1)], "x double, t double, e int")
    near = SV.fit_cox(df, ["x"], "t", "e")
    assert (near["n_rows"], near["n_dropped"]) == (120, 1)
    # moved far away, the same coefficient needs weights beyond a double without the shift
    far = SV.fit_cox(df.withColumn("x", F.col("x") + 2000), ["x"], "t", "e")
    assert far["coef"][0] == pytest.approx(near["coef"][0], abs=1e-6)


def test_cox_many_buckets_ties_and_aliased_columns(spark):
    rng = np.random.default_rng(4)
    n = 400
    X = rng.normal(size=(n, 4))
    t = rng.integers(1, 25, n).astype(float)  # day-resolution times: long ties
    e = (rng.random(n) < 0.6).astype(int)
    ref = cox_newton(X, t, e)
    pdf = pd.DataFrame(X, columns=list("abcd")).assign(t=t, e=e)
    pdf["same"], pdf["one"] = 2 * pdf["a"] - pdf["b"], 1.0
    df = spark.createDataFrame(pdf)
    small = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # times run over batches
    try:
        for buckets in (1, 6):
            m = SV.fit_cox(df, list("abcd"), "t", "e", n_buckets=buckets)
            assert np.allclose(m["coef"], ref, atol=1e-6) and m["aliased"] == []
        m = SV.fit_cox(df, ["a", "one", "b", "same", "c", "d"], "t", "e", n_buckets=6)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", small)
    assert m["aliased"] == ["one", "same"]
    assert np.allclose(m["coef"], [ref[0], 0, ref[1], 0, ref[2], ref[3]], atol=1e-6)
