import datetime as dt

import numpy as np
import pandas as pd
import pytest

from cohortkit.operators.history import STATS, history_stats, pivot_stats

T0 = dt.datetime(2024, 1, 10)


def brute(meas: pd.DataFrame, idx: pd.DataFrame, keys):
    rows = []
    for _, i in idx.iterrows():
        for test in sorted(meas["test"].unique()):
            m = meas[(meas["test"] == test) & (meas["t"] < i["t0"])]
            for k in keys:
                m = m[m[k].isna()] if pd.isna(i[k]) else m[(m[k] == i[k]).fillna(False)]
            m = m.dropna(subset=["v"])
            if m.empty:
                continue
            v = m["v"].to_numpy()
            o = m.sort_values(["t", "rid"])["v"].to_numpy()
            q = lambda p: float(np.quantile(v, p))  # noqa: E731  (numpy default = type 7)
            rows.append({**{k: i[k] for k in keys}, "test": test, "iid": i["iid"],
                         "mean": v.mean(), "median": q(.5), "max": v.max(), "min": v.min(),
                         "range": v.max() - v.min(), "sd": v.std(ddof=1) if len(v) > 1 else 0.0,
                         "iqr": q(.75) - q(.25), "first": o[0], "last": o[-1], "count": len(v)})
    return pd.DataFrame(rows)


def make(spark, meas_rows, idx_rows):
    meas = pd.DataFrame(meas_rows, columns=["sid", "hid", "test", "t", "rid", "v"])
    idx = pd.DataFrame(idx_rows, columns=["sid", "hid", "iid", "t0"])
    ms = spark.createDataFrame(meas, "sid long, hid long, test string, t timestamp, rid long, v double")
    ix = spark.createDataFrame(idx, "sid long, hid long, iid string, t0 timestamp")
    return meas, idx, ms, ix


def run(ms, ix, tests, chunk_rows=200_000, null_safe=True):
    out = history_stats(ms, ix, ["sid", "hid"], test_col="test", time_col="t", value_col="v", order_col="rid",
                        index_id="iid", index_time="t0", tests=tests, chunk_rows=chunk_rows,
                        null_safe=null_safe).toPandas()
    return out.sort_values(["iid", "test"]).reset_index(drop=True)


def check(out, ref):
    ref = ref.sort_values(["iid", "test"]).reset_index(drop=True)
    assert len(out) == len(ref)
    for c in STATS:
        np.testing.assert_allclose(out[c].astype(float), ref[c].astype(float), rtol=1e-9, atol=1e-9)


EDGE_MEAS = [
    # two index events x two tests in one admission (E5); values out of order
    (1, 10, "alt", T0 - dt.timedelta(days=3), 5, 30.0),
    (1, 10, "alt", T0 - dt.timedelta(days=5), 4, 10.0),
    (1, 10, "alt", T0 - dt.timedelta(days=1), 9, 20.0),
    (1, 10, "ast", T0 - dt.timedelta(days=2), 6, 7.0),
    (1, 10, "ast", T0, 7, 99.0),  # exactly at the index time: excluded (E6)
    # one-value group and two equal values
    (2, 20, "alt", T0 - dt.timedelta(days=2), 1, 3.0),
    (2, 20, "ast", T0 - dt.timedelta(days=2), 2, 4.0),
    (2, 20, "ast", T0 - dt.timedelta(days=1), 3, 4.0),
    # NULL value (never counted) and NULL admission id (matches NULL, E4)
    (3, None, "alt", T0 - dt.timedelta(days=1), 11, 8.0),
    (3, None, "alt", T0 - dt.timedelta(days=2), 12, None),
    # same instant, order decides first/last
    (4, 40, "alt", T0 - dt.timedelta(days=1), 21, 1.0),
    (4, 40, "alt", T0 - dt.timedelta(days=1), 20, 2.0),
]
EDGE_IDX = [
    (1, 10, "a", T0), (1, 10, "b", T0 + dt.timedelta(hours=1)),
    (2, 20, "c", T0), (3, None, "d", T0), (4, 40, "e", T0),
    (5, 50, "f", T0),  # no measurements at all
]


def test_edges_match_brute_force(spark):
    meas, idx, ms, ix = make(spark, EDGE_MEAS, EDGE_IDX)
    out = run(ms, ix, ["alt", "ast"])
    check(out, brute(meas, idx, ["sid", "hid"]))
    a = out[(out.iid == "a") & (out.test == "ast")].iloc[0]
    assert a["count"] == 1 and a["sd"] == 0.0  # value at the index time excluded; n=1 sd is 0
    e = out[out.iid == "e"].iloc[0]
    assert e["first"] == 2.0 and e["last"] == 1.0  # (time, order) decides
    assert set(out.iid) == {"a", "b", "c", "d", "e"}


def test_null_keys_not_matched_when_not_null_safe(spark):
    meas, idx, ms, ix = make(spark, EDGE_MEAS, EDGE_IDX)
    out = run(ms, ix, ["alt", "ast"], null_safe=False)
    assert "d" not in set(out.iid)


@pytest.mark.parametrize("chunk_rows", [3, 17, 1000])
def test_chunked_sweep_equals_brute_force(spark, chunk_rows):
    rng = np.random.default_rng(7)
    meas, idx = [], []
    rid = 0
    for sid in range(3):
        n = 150 if sid == 0 else 20  # one hot key
        for _ in range(n):
            rid += 1
            test = ["x", "y"][rng.integers(0, 2)]
            t = T0 + dt.timedelta(hours=int(rng.integers(0, 500)))
            meas.append((sid, sid, test, t, rid, float(rng.integers(0, 30))))
        for j in range(25 if sid == 0 else 5):
            idx.append((sid, sid, f"{sid}-{j}", T0 + dt.timedelta(hours=int(rng.integers(0, 520)))))
    m, i, ms, ix = make(spark, meas, idx)
    out = run(ms, ix, ["x", "y"], chunk_rows=chunk_rows)
    check(out, brute(m, i, ["sid", "hid"]))


@pytest.mark.parametrize("chunk_rows", [40, 900, 10_000])
def test_large_groups_in_chunks(spark, chunk_rows):
    """A group of nine tenths of the rows, half of them at one instant; groups with NULL keys; values that are nearly all
    different, and nearly all equal; chunks above and below the step of the stored counts."""
    rng = np.random.default_rng(13)
    meas, idx = [], []
    for rid in range(2400):
        sid = 1 if rid % 10 else None
        t = T0 if rid % 2 else T0 + dt.timedelta(minutes=int(rng.integers(-900, 900)))
        test = ["x", "y"][rid % 3 == 0]
        meas.append((sid, None if sid else 7, test, t, rid, float(rng.normal()) if test == "x" else float(rng.integers(0, 2))))
    for j in range(60):
        idx.append((1 if j % 4 else None, None if j % 4 else 7, f"i{j}", T0 + dt.timedelta(minutes=int(rng.integers(-950, 950)))))
    idx += [(1, None, "at", T0), (1, None, "after", T0 + dt.timedelta(seconds=1)), (2, 2, "none", T0)]
    m, i, ms, ix = make(spark, meas, idx)
    out = run(ms, ix, ["x", "y"], chunk_rows=chunk_rows)
    check(out, brute(m.astype({"sid": "Int64", "hid": "Int64"}), i.astype({"sid": "Int64", "hid": "Int64"}), ["sid", "hid"]))


def test_pivot_names_and_nulls(spark):
    meas, idx, ms, ix = make(spark, EDGE_MEAS, EDGE_IDX)
    long = history_stats(ms, ix, ["sid", "hid"], test_col="test", time_col="t", value_col="v", order_col="rid",
                         index_id="iid", index_time="t0", tests=["alt", "ast"])
    wide = pivot_stats(long, ["sid", "hid", "iid"], "test", ["alt", "ast"]).toPandas().set_index("iid")
    assert {"mean_alt", "count_ast", "iqr_ast"} <= set(wide.columns)
    assert pd.isna(wide.loc["e", "mean_ast"])  # absent test stays NULL
    assert len(wide.columns) == 3 + 20 - 1  # ids (sid, hid) + 20 stat columns; iid is the index


def test_empty_inputs_keep_schema(spark):
    _, _, ms, ix = make(spark, EDGE_MEAS, EDGE_IDX)
    out = history_stats(ms.limit(0), ix, ["sid", "hid"], test_col="test", time_col="t", value_col="v",
                        order_col="rid", index_id="iid", index_time="t0", tests=["alt"])
    assert out.count() == 0 and "median" in out.columns


def test_groups_straddling_arrow_batches(spark):
    rng = np.random.default_rng(12)
    meas, idx = [], []
    for sid in range(4):
        for r in range(40):
            meas.append((sid, sid, "x", T0 + dt.timedelta(hours=int(rng.integers(0, 300))), sid * 100 + r,
                         float(rng.integers(0, 9))))
        for j in range(6):
            idx.append((sid, sid, f"{sid}-{j}", T0 + dt.timedelta(hours=int(rng.integers(0, 320)))))
    m, i, ms, ix = make(spark, meas, idx)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = history_stats(ms, ix, ["sid", "hid"], test_col="test", time_col="t", value_col="v", order_col="rid",
                            index_id="iid", index_time="t0", tests=["x"], num_partitions=1).toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    check(out.sort_values(["iid", "test"]).reset_index(drop=True), brute(m, i, ["sid", "hid"]))


def test_ranks_among_prefixes_found_together():
    from cohortkit.operators.prefixstats import _find

    rng = np.random.default_rng(3)
    for codes, n in ((1, 9), (5, 40), (300, 700)):
        code, base = rng.integers(0, codes, n), rng.integers(0, 4, codes)
        before = rng.integers(1, n + 1, 60)
        k = (rng.random(60) * (before + base.sum())).astype(int)
        for b, r, c, inside in zip(before, k, *_find(code, base, before, k)):
            full = np.sort(np.concatenate([np.repeat(np.arange(codes), base), code[:b]]))
            assert full[r] == c and inside == r - np.searchsorted(full, c)


def test_grid_of_large_groups_grows_no_faster_than_the_rows(spark, monkeypatch):
    """Chunks times buckets, which one chunk size for all tables makes quadratic."""
    from cohortkit.operators import prefixstats

    chunks = []
    plain = prefixstats.positions
    monkeypatch.setattr(prefixstats, "positions", lambda df, order, n, *a, **k: chunks.append(n) or plain(df, order, n, *a, **k))
    n = 4000
    meas = spark.range(n).selectExpr("1L sid", "1L hid", "'x' test", "timestamp_seconds(id) t", "id rid", "double(id % 97) v")
    idx = spark.createDataFrame([(1, 1, "a", dt.datetime.fromtimestamp(n + 9))], "sid long, hid long, iid string, t0 timestamp")
    out = run(meas, idx, ["x"], chunk_rows=10).iloc[0]
    v = np.arange(n) % 97
    assert (out["count"], out["median"], out["iqr"]) == (n, np.median(v), np.quantile(v, .75) - np.quantile(v, .25))
    assert len(chunks) == 2 and 1 < chunks[0] * chunks[1] <= n / prefixstats.GRID ** 2 + n ** 0.5
