"""Histogram boosting against a plain version, and against itself over other blocks."""
import numpy as np
import pandas as pd
import pytest
from pyspark import RDD

from cohortkit.operators import boosting as BO
from cohortkit.operators.metrics import roc_auc


def rows(n=600, seed=5, nulls=True):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n).round(1), rng.integers(0, 2, n), rng.exponential(size=n).round(1), np.zeros(n)])
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=n) > 0.8).astype(float)
    pdf = pd.DataFrame({"id": range(n), "features": x.tolist(), "a": y, "b": (x[:, 2] > 1).astype(float),
                        "w": 1 + rng.integers(0, 3, n) / 2, "f": np.arange(n) % 3})
    if nulls:
        pdf.loc[pdf.id % 50 == 7, "a"] = None
    return pdf


def frame(spark, pdf):
    return spark.createDataFrame(pdf.astype({"a": object}).where(pdf.notna(), None),
                                 "id long, features array<double>, a double, b double, w double, f int")


def plain_fit(x, y, w, depth, step, trees):
    """Exact second-order boosting: every distinct value is a cut."""
    base = np.log((w * y).sum() / (w * (1 - y)).sum())
    m = np.full(len(x), base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-m))
        g, h = w * (p - y), w * p * (1 - p)
        add = np.zeros(len(x))

        def node(r, d):
            G, H = g[r].sum(), h[r].sum()
            add[r] = -step * G / (H + 1)
            best = None
            for j in range(x.shape[1] if d < depth else 0):
                for c in np.unique(x[r, j])[:-1]:
                    left = r[x[r, j] <= c]
                    gl, hl = g[left].sum(), h[left].sum()
                    if hl >= 1 and H - hl >= 1:
                        gain = gl ** 2 / (hl + 1) + (G - gl) ** 2 / (H - hl + 1) - G ** 2 / (H + 1)
                        if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                            best = gain, j, c
            if best:
                node(r[x[r, best[1]] <= best[2]], d + 1)
                node(r[x[r, best[1]] > best[2]], d + 1)

        node(np.arange(len(x)), 0)
        m = m + add
    return m


@pytest.mark.parametrize("weighted", [True, False])
def test_equals_a_plain_fit(spark, weighted):
    pdf = rows(300)
    b = BO.bin_rows(frame(spark, pdf), [("a", "w", None)], max_bins=255)
    (base, trees), = BO.fit(b, [BO.Chain(0, -1, 3, 0.2, weighted)], [6])
    got = BO.Forest.of(base, trees, b.cuts).margins(np.stack(pdf.features.to_numpy()))
    use = pdf.a.notna().to_numpy()
    x = np.stack(pdf.features.to_numpy())
    w = pdf.w.to_numpy() if weighted else np.ones(len(pdf))
    assert np.abs(got[use] - plain_fit(x[use], pdf.a.to_numpy()[use], w[use], 3, 0.2, 6)).max() < 1e-5


def test_blocks_do_not_change_the_trees(spark):
    """One block (trees grown in its task) and many (histograms summed over the cluster) give the same trees, bit for bit."""
    df = frame(spark, rows())
    chains = [BO.Chain(t, f, d, 0.2) for t in (0, 1) for f in (-1, 0, 2) for d in (2, 4)]
    targets = [("a", "w", "f"), ("b", None, "f")]
    one, many = BO.bin_rows(df, targets), BO.bin_rows(df, targets, cells=300)
    assert one.count == 1 and many.count == 8 and many.blocks.count() == 8
    s1, s2 = [], []
    r1, r2 = BO.fit(one, chains, [2, 5], every=3, scored=s1), BO.fit(many, chains, [2, 5], every=3, scored=s2)
    for (b1, t1), (b2, t2) in zip(r1, r2):
        assert b1 == b2 and len(t1) == len(t2) == 5
        assert all((p == q).all() for u, v in zip(t1, t2) for p, q in zip(u, v))
    for a, b in zip(s1, s2):
        key = ["chain", "y", "score"]
        a, b = (d.toPandas().sort_values(key)[key].to_numpy() for d in (a, b))
        assert len(a) and (a == b).all()


def test_rows_of_a_block_are_bounded_and_a_partition_holds_one_block(spark, monkeypatch):
    """Few features give blocks of many rows; one read task may get many blocks, which no Python worker holds together."""
    df = frame(spark, rows())
    one, many = BO.bin_rows(df, [("b", None, None)]), BO.bin_rows(df, [("b", None, None)], rows=100)
    assert one.count == 1 and many.count == 6 and max(r.n for r in many.blocks.collect()) <= 101
    (b1, t1), = BO.fit(one, [BO.Chain(0, -1, 2, 0.2)], [3])
    plain = RDD.partitionBy  # sums of histograms are reduced with it, by key
    monkeypatch.setattr(RDD, "partitionBy", lambda self, n, *how: pytest.fail("blocks") if int in how else plain(self, n, *how))
    (b2, t2), = BO.fit(many._replace(blocks=many.blocks.coalesce(1)), [BO.Chain(0, -1, 2, 0.2)], [3])
    assert b1 == b2 and all((p == q).all() for u, v in zip(t1, t2) for p, q in zip(u, v))


def test_stages_and_grid_equal_separate_fits(spark):
    pdf = rows(nulls=False)
    df = frame(spark, pdf)
    b = BO.bin_rows(df, [("a", "w", "f"), ("b", "w", "f")])
    points = BO.search(b, 2, {"maxIter": [2, 5], "maxDepth": [2, 3], "stepSize": [0.1]}, 3)
    assert [len(p) for p in points] == [4, 4]
    for target, label in enumerate("ab"):
        for p in points[target]:
            aucs = []
            for fold in range(3):
                (base, trees), = BO.fit(b, [BO.Chain(target, fold, p["maxDepth"], 0.1)], [p["maxIter"]])
                held = df.filter(df.f == fold)
                s = BO.predict(BO.Forest.of(base, trees, b.cuts), held)
                aucs.append(roc_auc(s.withColumn("y", s[label].cast("int")), "y", "score").first()[0])
            assert abs(p["score"] - np.mean(aucs)) < 1e-9


def test_nan_constant_column_one_class_and_empty(spark):
    pdf = rows(200)
    pdf["features"] = [[float("nan") if i % 9 == 0 else v[0], *v[1:]] for i, v in enumerate(pdf.features)]
    df = frame(spark, pdf)
    b = BO.bin_rows(df, [("a", None, None)])
    assert len(b.cuts[3]) == 0  # one value, no cut
    (base, trees), = BO.fit(b, [BO.Chain(0, -1, 2, 0.3)], [3])
    m = BO.Forest.of(base, trees, b.cuts)
    got = BO.predict(m, df).orderBy("id").toPandas()
    assert got.score.between(0, 1).all() and ((got.score > 0.5) == (got.prediction == 1)).all()
    one = BO.bin_rows(df.filter("a = 1"), [("a", None, "f")])
    assert all(p["score"] is None for p in BO.search(one, 1, {"maxIter": [2], "maxDepth": [2], "stepSize": [0.1]}, 3)[0])
    none = BO.bin_rows(df.limit(0), [("a", None, "f")])
    assert BO.fit(none, [BO.Chain(0, -1, 2, 0.1)], [2]) == [(0.0, [])]


def test_save_load_importance(spark, tmp_path):
    pdf = rows(300)
    df = frame(spark, pdf)
    b = BO.bin_rows(df, [("a", None, None)])
    m, = BO.refit(b, [{"maxIter": 4, "maxDepth": 3, "stepSize": 0.2}])
    m.save(spark, str(tmp_path / "m"))
    back = BO.Forest.load(spark, str(tmp_path / "m"))
    x = np.stack(pdf.features.to_numpy())
    assert (back.margins(x) == m.margins(x)).all() and back.numFeatures == 4
    imp = {r["feature"]: r["splits"] for r in BO.split_count_importance(m, spark, ["p", "q", "r", "s"]).collect()}
    want = pd.Series(np.concatenate([t[0][t[0] >= 0] for t in m.trees])).value_counts()
    assert imp == {"pqrs"[k]: v for k, v in want.items()} and "s" not in imp
