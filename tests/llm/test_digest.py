import hashlib

import numpy as np
from pyspark.sql import functions as F

from cohortkit.llm import digest


def test_entropy_levels_equal_a_direct_count():
    rng = np.random.default_rng(0)
    buf = rng.integers(97, 110, 3000).astype(np.uint8)
    lev = digest.entropy_levels(buf)
    for i in range(0, len(lev), 37):
        c = np.bincount(buf[i:i + 64])
        c = c[c > 0] / 64
        assert abs(-(c * np.log2(c)).sum() / 6 * 1000 - lev[i]) <= 1.01


def test_features_equal_a_direct_selection():
    rng = np.random.default_rng(1)
    rank = digest.rank_levels(rng.integers(0, 9, 1001).tolist())
    text = bytes(rng.integers(97, 105, 700).astype(np.uint8))
    r = rank[digest.entropy_levels(np.frombuffer(text, np.uint8))]
    points = np.zeros(len(r), int)
    for i in range(len(r)):
        run = [(r[j], j) for j in range(i, min(i + 64, len(r))) if r[j] >= 0]
        if run:
            points[min(run)[1]] += 1
    n = int((points >= 16).sum())
    d = digest.digests([b"x" * 10, text, b"", text], rank)
    assert np.array_equal(d[1], d[3]) and len(d[2]) == 0 and len(d[0]) == 1
    one_by_one = digest.digests([text], rank)[0]
    assert np.array_equal(one_by_one, d[1])
    assert n > 0 and np.bitwise_count(d[1]).sum() <= 5 * n and np.bitwise_count(d[1]).sum() > 4 * n


def test_likeness_bounds():
    rank = digest.rank_levels(list(range(1001)))
    rng = np.random.default_rng(2)
    a, b = (bytes(rng.integers(97, 122, 9000).astype(np.uint8)) for _ in range(2))
    x, y, z, none = digest.digests([a, b, a[:4500] + b[4500:], b""], rank)
    assert digest.likeness(x, x) == 1 and digest.likeness(none, none) == 1 and digest.likeness(x, none) == 0
    assert digest.likeness(x, y) < 0.1 < 0.35 < digest.likeness(x, z) < 0.75


def test_query_follows_descending_ids(small_docs, small_rows, no_docs):
    rows = {r[0]: r[1] or "" for r in small_rows if r[0] is not None}
    ids = sorted(rows, reverse=True)
    d = small_docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    for size in (1 << 30, 20_000):
        # one bucket, then many
        counts = digest.level_counts(d)
        assert sum(counts) == sum(max(0, len(t.encode()) - 63) for t in rows.values())
        order = digest.in_order(d, bucket_bytes=size).withColumn("p", F.spark_partition_id()).collect()
        nxt = {}
        for x, y in zip(order, order[1:]):
            if not x["edge"]:
                assert x["bucket"] == y["bucket"]
                nxt[x["id"]] = y["text"]
        assert nxt == {i: rows[j] for i, j in zip(ids, ids[1:] + ids[:1])}
    got = {r["doc_id"]: r for r in digest.fingerprint_table(d).collect()}
    assert set(got) == set(rows)
    by_text = {}
    for i, j in zip(ids, ids[1:] + ids[:1]):
        t, r = rows[i], got[i]
        half = len(t) // 2
        e = t[:len(t) - half] + rows[j][:half]
        assert r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest() and r["n_chars"] == len(t)
        assert by_text.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if t == rows[j]:
            assert r["near_next"] == 1
    assert digest.fingerprint_table(no_docs).count() == 0
    assert digest.fingerprint_table(small_docs).count() == len(small_rows)
    assert digest.fingerprint_table(d.filter(F.col("doc_id") == ids[0])).first()["near_next"] == 1
