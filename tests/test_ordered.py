import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortkit.operators.ordered import positions, totals_before


def test_positions_follow_the_order_and_are_unique(spark):
    rng = np.random.default_rng(1)
    rows = [(int(a), float(b), i) for i, (a, b) in enumerate(zip(rng.integers(0, 3, 500), rng.random(500)))]
    d = spark.createDataFrame(rows, "a int, b double, i int").repartition(6)
    p = positions(d, ["a", F.desc("b")], 9).orderBy("_pos").collect()
    assert [r["i"] for r in p] == [r[2] for r in sorted(rows, key=lambda r: (r[0], -r[1]))]
    assert len({r["_pos"] for r in p}) == 500
    chunks = [r["_chunk"] for r in p]
    assert chunks == sorted(chunks) and len(set(chunks)) > 5  # a key of a third of the rows spans chunks


@pytest.mark.parametrize("fan", [2, 3, 1024])
@pytest.mark.parametrize("after", [False, True])
def test_totals_before_in_blocks_of_blocks(spark, fan, after):
    """Three levels of blocks with fan 3; groups lack some chunks; a NULL group is one."""
    rng = np.random.default_rng(2)
    rows = [(g, int(c), int(rng.integers(1, 100))) for g in ("x", "y", None) for c in rng.permutation(40)[:25]]
    t = spark.createDataFrame(rows, "g string, c long, v long")
    got = {(r["g"], r["c"]): r["_o_v"] for r in totals_before(t, "c", ["v"], ["g"], after, fan=fan).collect()}
    for g, c, _ in rows:
        assert got[g, c] == sum(v for h, d, v in rows if h == g and (d > c if after else d < c))
    assert len(got) == len(rows)


@pytest.mark.parametrize("descending,inclusive", [(False, True), (True, False)])
@pytest.mark.parametrize("groups", [[], ["g"]])
def test_running_sums_over_more_chunks_than_shuffle_partitions(spark, monkeypatch, descending, inclusive, groups):
    """90 chunks in blocks of blocks; one group holds nine tenths of the rows; a NULL group; a NULL key comes last."""
    from cohortkit.operators import ordered
    from cohortkit.operators.prefix import running_sums

    real = ordered.totals_before
    monkeypatch.setattr(ordered, "totals_before", lambda *a, **kw: real(*a[:6], **{**kw, "fan": 5}))
    rng = np.random.default_rng(3)
    rows = [("x" if i % 10 else (None if i % 20 else "y"), float(k), int(rng.integers(1, 50)))
            for i, k in enumerate(rng.permutation(900))]
    d = spark.createDataFrame(rows, "g string, k double, v long").repartition(5)
    got = running_sums(d, "k", ["v"], descending=descending, inclusive=inclusive, partition_by=groups, keys_per_chunk=10)
    assert int(spark.conf.get("spark.sql.shuffle.partitions")) < 90
    for r in got.collect():
        want = sum(v for g, k, v in rows if (not groups or g == r["g"])
                   and (k > r["k"] if descending else k < r["k"] or k == r["k"] and inclusive))
        assert r["cum_v"] == want
    d = spark.createDataFrame([(1.0, 5), (None, 7), (float("nan"), 3), (0.5, 2)], "k double, v long")
    for chunks in (1, 3):
        out = {str(r["k"]): r["cum_v"] for r in running_sums(d, "k", ["v"], n_chunks=chunks).collect()}
        assert out == {"0.5": 2, "1.0": 7, "nan": 10, "None": 17}
