"""Prior-code flags, outcome windows without pairs, top-k and the report's odd groups, against plain loops."""

import datetime as dt
import random

from cohortkit.operators import labels as L
from cohortkit.operators import metrics as M
from cohortkit.operators import summaries as SM

T0 = dt.datetime(2020, 1, 1)


def _at(days):
    return None if days is None else T0 + dt.timedelta(days=days)


def test_outcome_within_equals_pairs(spark):
    rng = random.Random(3)
    idx = [(k, i, rng.choice([None, 0, 1, 29, 30, rng.uniform(0, 200)])) for i, k in enumerate([1, 2, 2, 3, None] * 20)]
    tests = [(rng.choice([1, 2, None]), rng.choice([None, 1, 30, 31, rng.uniform(-40, 260)])) for _ in range(60)]
    tests += [(2, 30)] * 5
    a = spark.createDataFrame([(k, i, _at(t)) for k, i, t in idx], "k long, id long, t0 timestamp")
    b = spark.createDataFrame([(k, _at(t)) for k, t in tests], "k long, ts timestamp")
    for lag, horizon in ((1, 30), (0, 2)):
        got = {r.id: r.hit for r in L.outcome_within(a, b, "k", "t0", "ts", horizon, lag, name="hit").collect()}
        assert len(got) == len(idx)
        for k, i, t in idx:
            want = any(k is not None and k == k2 and None not in (t, u)
                       and _at(t + lag) <= _at(u) <= _at(t + horizon) for k2, u in tests)
            assert got[i] == want, (k, i, t)
    assert L.outcome_within(a.limit(0), b, "k", "t0", "ts").count() == 0
    assert {r.outcome for r in L.outcome_within(a, b.limit(0), "k", "t0", "ts").collect()} == {0}


def test_prior_code_flags(spark):
    a = spark.createDataFrame([(1, 1, _at(5)), (1, 2, _at(0)), (None, 3, _at(5)), (2, 4, _at(5)), (1, 5, None)],
                              "k long, id long, t timestamp")
    c = spark.createDataFrame([(1, _at(0), "A"), (1, _at(1), "A"), (None, _at(4), "B"), (2, _at(5), "B"), (2, None, "A")],
                              "k long, t timestamp, code string")
    got = {r.id: (r.had_A, r.had_B) for r in L.prior_code_flags(a, c, ["k"], "t", "t", "code", ["A", "B"], "had_").collect()}
    assert got == {1: (1, 0), 2: (0, 0), 3: (0, 1), 4: (0, 0), 5: (0, 0)}


def test_top_k(spark):
    d = spark.createDataFrame([("b", 2), ("a", 2), ("c", 3), ("n", None)], "x string, v int")
    assert [r.x for r in SM.top_k(d, "v", 3, ["x"]).collect()] == ["c", "a", "b"]
    assert [r.x for r in SM.top_k(d, "v", 9, ["x"]).collect()] == ["c", "a", "b", "n"]


def test_report_of_one_class_and_null_group(spark):
    d = spark.createDataFrame([("a", 1, 1), ("a", 1, 0), (None, 0, 0), (None, 1, 0)], "g string, y int, p int")
    r = M.classification_report(d, "y", "p", ["g"])
    assert not any("Union" in x or "Join" in x for x in r._jdf.queryExecution().optimizedPlan().toString().split())
    got = {(x.g, x["class"]): (x.precision, round(x.recall, 6), x.support) for x in r.collect()}
    assert got[("a", "1")] == (1.0, 0.5, 2) and got[("a", "0")] == (0.0, 0.0, 0)
    assert got[("a", "weighted avg")] == (1.0, 0.5, 2) and got[(None, "accuracy")] == (0.5, 0.5, 2)
    assert got[(None, "macro avg")] == (0.25, 0.5, 2)
