import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cohortkit.llm import kdshards, mixing


def _targets(sizes):
    """Fill by weight, cap at twice the source, deal the excess again."""
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, got = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > 2 * sizes[s]}
        if not over:
            got.update({s: left * w[s] / total for s in open_})
            break
        got.update({s: 2.0 * sizes[s] for s in over})
        left -= sum(2.0 * sizes[s] for s in over)
        open_ -= over
    return got


def test_mix_follows_targets(small_docs, small_rows, no_docs):
    d = mixing.systematic_copies(small_docs, carry=["doc_id"]).select(
        "doc.doc_id", "size", "source_size", "target", "copies").collect()
    words = {(r[0], r[1]): len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in small_rows}
    assert Counter((r["doc_id"], r["size"]) for r in d) == Counter((r[0], words[r[0], r[1]]) for r in small_rows)
    sizes, source = Counter(), {r[0]: r[3] for r in small_rows}
    for r in small_rows:
        sizes[r[3]] += words[r[0], r[1]]
    want = _targets(sizes)
    taken, most = Counter(), defaultdict(int)
    for r in d:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and math.isclose(r["target"], want[s], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r["copies"] <= 2
        taken[s] += r["copies"] * r["size"]
        most[s] = max(most[s], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * most[s] + 0.1 * want[s]
    again = mixing.systematic_copies(small_docs.repartition(3), carry=["doc_id"]).select("doc.doc_id", "size", "copies")
    assert Counter(map(tuple, again.collect())) == Counter((r["doc_id"], r["size"], r["copies"]) for r in d)
    assert mixing.mix(no_docs).count() == 0
    out = mixing.mix(small_docs.withColumn("size", F.lit("x")))
    assert out.columns == [*small_docs.columns, "size"] and out.count() == sum(r["copies"] for r in d)


def test_one_size_and_one_hot_source(spark):
    d = spark.range(3000).selectExpr("id as doc_id", "'a b c' as text", "if(id % 3 = 0, 'x', 'hot') as source")
    r = mixing.systematic_copies(d, carry=["doc_id"]).groupBy("source_size").agg(
        F.sum(F.col("size") * F.col("copies")).alias("t"), F.first("target").alias("g")).collect()
    assert len(r) == 2 and all(abs(x["t"] - x["g"]) <= 3 for x in r)


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_shards(small_docs, small_rows, shards):
    rows = kdshards.shard(small_docs, shards=shards, rows_per_run=10).collect()
    assert len(rows) == len(small_rows)
    text = {r[0]: r[1] for r in small_rows}
    slots, size = defaultdict(list), Counter()
    for r in rows:
        t = (text[r["doc_id"]] or "").encode()
        assert r["size"] == len(t) + 16 and r["text_crc32"] == zlib.crc32(t) and r["law"] == "bytes" and r["grown_shard"] is None
        assert 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
        size[r["shard"]] += r["size"]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards_are_balanced_also_with_a_hot_text(spark, no_docs):
    d = spark.range(20000).selectExpr(
        "id as doc_id", "if(id % 3 = 0, repeat('same words ', 20), repeat(cast(id as string), int(5 + id % 97))) as text",
        "if(id % 2 = 0, 'src0', concat('s', id % 11)) as source", "'en' as lang")
    g = kdshards.shard(d).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    mean = sum(r["b"] for r in g) / 40
    assert len(g) == 40 and all(abs(r["b"] - mean) < 0.1 * mean for r in g)
    assert kdshards.shard(no_docs).count() == 0


def test_equal_texts_share_a_shard_while_they_fit(spark):
    """Groups of 1/6 and of 3/4 of a shard stay whole, and sizes stay near equal."""
    d = spark.range(12000).selectExpr(
        "id as doc_id", "if(id % 40 < 3, concat('heavy ', repeat('x', 100), id % 40), if(id % 40 < 5, concat('lighter', id % 40, 'y'),"
        " concat('own ', id, repeat('z', int(id % 90))))) as text",
        "concat('s', id % 7) as source", "if(id % 5 = 0, null, 'en') as lang")
    r = kdshards.shard(d, shards=20).cache()
    mean = r.agg(F.sum("size")).first()[0] / 20
    groups = r.groupBy("text_crc32", "size").agg(F.sum("size").alias("b"), F.countDistinct("shard").alias("k"))
    assert groups.filter((F.col("b") > mean / 8) & (F.col("b") <= mean)).count() == 5
    assert groups.filter((F.col("b") <= mean) & (F.col("k") > 1)).count() == 0
    sizes = [x["b"] for x in r.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 20 and all(abs(b - mean) < 0.05 * mean for b in sizes)


def test_extreme_ids_and_clashing_columns(spark):
    d = spark.createDataFrame([(-2 ** 63, "a", 1), (2 ** 63 - 1, "b c", 2), (0, None, 3), (None, "", 4)],
                              "doc_id long, text string, size int").selectExpr(
        "*", "'x' as source", "'en' as lang", "size as shard", "size as piece", "size as bytes", "size as th")
    r = kdshards.shard(d, shards=3).collect()
    assert sorted((x["doc_id"] is None, x["doc_id"] or 0, x["size"]) for x in r) == sorted(
        [(False, -2 ** 63, 17), (False, 2 ** 63 - 1, 19), (False, 0, 16), (True, 0, 16)])


def _plain_tree(points, shards, room):
    """Recursion over sorted points: {point: leaf}."""
    out = {}

    def go(ps, first, k):
        if k == 1:
            out.update({p: first for p in ps})
            return
        here = room[first:first + k]
        share = sum(here[:k // 2]) / sum(here)
        if ps:
            width = [max(p[0][j] for p in ps) // 2 ** kdshards.TIE_BITS - min(p[0][j] for p in ps) // 2 ** kdshards.TIE_BITS
                     for j in range(len(kdshards.DIMS))]
            dim = width.index(max(width))
            ps = sorted(ps, key=lambda p: p[0][dim])
            want, acc, at = share * sum(p[1] for p in ps), 0, 0
            while acc + ps[at][1] < want:
                acc += ps[at][1]
                at += 1
            at += acc + ps[at][1] - want <= want - acc
            go(ps[:at], first, k // 2)
            go(ps[at:], first + k // 2, k - k // 2)

    go(points, 0, shards)
    return out


@pytest.mark.parametrize("room", [None, [5.0, 1.0, 2.0, 0.5, 3.0, 3.0, 1.5]])
def test_tree_equals_a_plain_recursion(spark, room):
    import random

    r = random.Random(3)
    tie = [r.getrandbits(kdshards.TIE_BITS) for _ in range(400)]
    points = [(tuple(r.choice([r.randrange(1 << 20), 77, 500_000 // (j + 1)]) << kdshards.TIE_BITS | t for j in range(4)),
               r.randrange(1, 300)) for t in tie]
    df = spark.createDataFrame([(list(k), b) for k, b in points], "key array<bigint>, bytes long")
    tree = kdshards.build(df, 7, slack=0.0, room=room)
    got = df.select("key", "bytes", F.get(kdshards._ints(tree.first), tree.node()).alias("leaf")).collect()
    want = _plain_tree(points, 7, room or [1.0] * 7)
    assert {(tuple(x["key"]), x["bytes"]): x["leaf"] for x in got} == want
