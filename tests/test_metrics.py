import numpy as np
import pandas as pd
import pytest

from cohortkit.operators import metrics as M
from cohortkit.operators.prefix import running_sums


def brute_auc(y, s):
    pos = s[y == 1]
    neg = s[y == 0]
    tot = 0.0
    for p in pos:
        tot += (neg < p).sum() + 0.5 * (neg == p).sum()
    return tot / (len(pos) * len(neg))


def brute_ap(y, s):
    # step-wise AP over distinct thresholds, descending
    ths = np.unique(s)[::-1]
    P = (y == 1).sum()
    ap, prev_r = 0.0, 0.0
    for t in ths:
        sel = s >= t
        tp = ((y == 1) & sel).sum()
        prec = tp / sel.sum()
        r = tp / P
        ap += (r - prev_r) * prec
        prev_r = r
    return ap


def test_auc_ap_curves_with_ties_and_groups(spark):
    rng = np.random.default_rng(0)
    n = 300
    g = rng.integers(0, 3, n)
    y = rng.integers(0, 2, n)
    s = np.round(rng.normal(size=n) + y, 1)  # ties
    pdf = pd.DataFrame({"g": g, "y": y, "s": s})
    df = spark.createDataFrame(pdf)
    auc = {r["g"]: r["roc_auc"] for r in M.roc_auc(df, "y", "s", ["g"]).collect()}
    ap = {r["g"]: r["average_precision"] for r in M.average_precision(df, "y", "s", ["g"]).collect()}
    for k in range(3):
        m = g == k
        assert abs(auc[k] - brute_auc(y[m], s[m])) < 1e-12
        assert abs(ap[k] - brute_ap(y[m], s[m])) < 1e-12
    roc = M.roc_curve(df, "y", "s").toPandas().sort_values("threshold", ascending=False)
    assert roc["fpr"].is_monotonic_increasing and abs(roc["tpr"].iloc[-1] - 1) < 1e-12
    pr = M.pr_curve(df, "y", "s").toPandas()
    assert len(pr) == len(np.unique(s))


def _library_points(y, s):
    """The reference library's default curve: distinct scores from the top, collinear points dropped, (0, 0) put first."""
    cut = np.unique(s)[::-1]
    fps = np.array([np.sum((s >= c) & (y == 0)) for c in cut])
    tps = np.array([np.sum((s >= c) & (y == 1)) for c in cut])
    if len(fps) > 2:
        keep = np.r_[True, (np.diff(fps, 2) != 0) | (np.diff(tps, 2) != 0), True]
        fps, tps, cut = fps[keep], tps[keep], cut[keep]
    return [(np.inf, 0.0, 0.0), *zip(cut, fps / max(fps[-1], 1), tps / max(tps[-1], 1))]


@pytest.mark.parametrize("chunk", [50_000, 7, 1])
def test_roc_corners_across_chunks(spark, chunk):
    """Long runs of equal steps, which cross the borders of small chunks; tied scores; a group of one score."""
    rng = np.random.default_rng(6)
    rows = []
    for g, n in ((0, 60), (1, 41), (2, 1)):
        y = np.repeat(rng.integers(0, 2, n // 6 + 1), 6)[:n]  # runs of one class
        rows += [(g, int(a), float(b)) for a, b in zip(y, np.arange(n) // (1 + g))]
    rows += [(3, a, 0.5) for a in (0, 1, 1)]
    df = spark.createDataFrame(rows, "g int, y int, s double")
    got = M.roc_curve(df, "y", "s", ["g"], drop_intermediate=True, start=True, chunk_rows=chunk).fillna(0.0).collect()
    for g in range(4):
        y, s = (np.array([r[i] for r in rows if r[0] == g]) for i in (1, 2))
        mine = sorted(((r["threshold"], r["fpr"], r["tpr"]) for r in got if r["g"] == g), reverse=True)
        want = _library_points(y, s)
        assert len(mine) == len(want) and np.allclose(np.nan_to_num(np.array(mine[1:])), np.array(want[1:])) and mine[0] == want[0]
    assert len(got) < len(M.roc_curve(df, "y", "s", ["g"]).collect())
    whole = M.roc_curve(df.filter("g = 0"), "y", "s", drop_intermediate=True, start=True, chunk_rows=chunk)
    assert whole.count() == len(_library_points(*(np.array([r[i] for r in rows if r[0] == 0]) for i in (1, 2))))


def test_perfect_reversed_and_report(spark):
    # Perfect and reversed ranking; classification report hand values
    df = spark.createDataFrame([(1, 0.9, 1), (1, 0.8, 0), (0, 0.3, 0), (0, 0.1, 1)], "y int, s double, p int")
    assert M.roc_auc(df, "y", "s").first()[0] == 1.0
    rev = spark.createDataFrame([(1, 0.1), (0, 0.9)], "y int, s double")
    assert M.roc_auc(rev, "y", "s").first()[0] == 0.0
    rep = {r["class"]: r for r in M.classification_report(df, "y", "p").collect()}
    assert rep["1"]["precision"] == 0.5 and rep["1"]["recall"] == 0.5 and rep["1"]["support"] == 2
    assert rep["accuracy"]["f1_score"] == 0.5 and rep["macro avg"]["support"] == 4
    one = spark.createDataFrame([(0, 0)], "y int, p int")
    r1 = {r["class"]: r for r in M.classification_report(one, "y", "p").collect()}
    assert r1["1"]["precision"] == 0.0 and r1["0"]["recall"] == 1.0  # zero division gives 0


def test_running_sums_grouped(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": rng.integers(0, 4, 200), "k": rng.permutation(200).astype(float),
                        "x": rng.integers(0, 9, 200)})
    df = spark.createDataFrame(pdf)
    for desc, incl, nch in ((False, True, 5), (True, False, 3), (True, True, 1)):
        out = running_sums(df, "k", ["x"], descending=desc, inclusive=incl, partition_by=["g"],
                           n_chunks=nch).toPandas()
        ref = pdf.sort_values("k", ascending=not desc)
        ref["c"] = ref.groupby("g")["x"].cumsum() - (0 if incl else ref["x"])
        m = out.merge(ref, on=["g", "k"])
        assert (m["cum_x"] == m["c"]).all() and len(m) == 200
