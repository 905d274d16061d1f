import numpy as np
import xxhash
from pyspark.sql import functions as F

from cohortkit.llm import simhash


def _fp(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).translate(
        {c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    if not words:
        return 0
    sh = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    ones = [0] * 64
    for s in sh:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(sh))


def _roots(fps, radius):
    p = {f: f for f in fps}

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    u = sorted(p)
    for i, a in enumerate(u):
        for b in u[i + 1:]:
            if bin(a ^ b).count("1") <= radius:
                p[find(a)] = find(b)
    return {f: find(f) for f in u}


def test_fingerprints_and_components_equal_brute_force(small_docs, small_rows, no_docs):
    got = simhash.near_duplicates(small_docs).select("doc_id", simhash.hex_fp(F.col("fp")).alias("f"), "component_id").collect()
    assert len(got) == len(small_rows)
    fps = {}
    for i, t, *_ in small_rows:
        fps.setdefault(i, _fp(t or ""))
    root = _roots(set(fps.values()), 4)
    least = {}
    for i, f in fps.items():
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    for r in got:
        if r["doc_id"] is not None:
            assert r["f"] == format(fps[r["doc_id"]], "016x")
            assert r["component_id"] == least[root[fps[r["doc_id"]]]]
    assert simhash.near_duplicates(no_docs).count() == 0


def test_masks_cover_every_pair_within_the_radius():
    rng = np.random.default_rng(0)
    for radius in (1, 2, 4):
        masks = simhash.covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(2000):
            diff = sum(1 << int(b) for b in rng.choice(64, rng.integers(0, radius + 1), replace=False))
            assert any(diff & m == 0 for m in masks)


def test_large_buckets_in_small_blocks(spark):
    """Chains and clusters of fingerprints, buckets far beyond a block."""
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 1 << 62, 6)]
    fps = set()
    for b in base:
        x = b
        for _ in range(60):
            for k in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(k)
            fps.add(x)
        fps.update(b ^ (1 << i) for i in range(40))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    for block in (8, 4096):
        got = {r["node"]: r["root"] for r in simhash.link_roots(nodes, 4, block=block).collect()}
        want = _roots(fps, 4)
        pairs = {}
        for f, s in zip(fps, signed):
            pairs.setdefault(want[f], set()).add(got.get(s, s))
        assert all(len(v) == 1 for v in pairs.values())
        assert len({next(iter(v)) for v in pairs.values()}) == len(pairs)


def test_keep_one_keeps_columns_and_one_row_each(small_docs, small_rows, no_docs):
    d = small_docs.withColumn("fp", F.lit("mine")).withColumn("size", F.lit(1))
    kept = simhash.keep_one(d)
    assert kept.columns == d.columns
    lab = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(small_docs).collect()}
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(ids) == sorted({c for c in lab.values() if c is not None})
    assert simhash.keep_one(no_docs).count() == 0
