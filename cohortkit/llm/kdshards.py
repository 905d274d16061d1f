"""Sharding by a k-d tree over document metadata (law: near-equal bytes).

The points are groups of equal texts with their bytes; their dimensions are text length (log scale),
source, language and id, each scaled to 20 bits.  A node that holds k shards is split along its widest
dimension at the byte-weighted quantile floor(k / 2) / k, and so on until each leaf is one shard of the target
size.  Quantiles are found for all nodes of a level at once: byte histograms over 10 bits of the key (value,
then a hash that orders ties) are narrowed until the bin that holds the cut is light enough; only
histograms of at most 1,024 bins per node reach the driver.  The tree (under 2 x shards nodes) is applied as one expression.

Equal texts share a shard while they fit in one.  Groups heavier than 1/8 of a shard (fewer than 8 x shards of them) are
packed first, heaviest first, each whole into the emptiest shard; the tree deals the others into the room that is left, so its
cuts lie at the share of the room on either side.  A heavy group that fits in no shard's room (one text with very
many copies) is divided into pieces of about 1/8 of a shard by a hash of the row, and its pieces are points of the tree.

Defined cases: NULL text has 16 bytes and crc32 0; NULL ids, sources and languages take the lowest place; repeated
rows are rows of one group; a table with fewer groups than shards leaves some empty; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortkit.llm.common import text_or_empty
from cohortkit.session import materialize

DIMS = ("d_len", "d_source", "d_lang", "d_id")
VALUE_BITS, TIE_BITS, DIGIT = 20, 40, 10
TOP = (1 << VALUE_BITS) - 1


def _ints(xs) -> Column:
    return F.array(*[F.lit(int(x)) for x in xs])


def _name_place(c: Column) -> Column:
    return F.when(c.isNull(), F.lit(0)).otherwise(F.crc32(c.cast("binary")) % TOP + 1)


def _meta(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str) -> DataFrame:
    t = text_or_empty(F.col(text_col))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        F.xxhash64(t).alias("th"),
        F.least(F.lit(TOP), (F.log2(F.octet_length(t) + F.lit(1.0)) * (TOP / 32)).cast("int")).alias("d_len"),
        _name_place(F.col(source_col)).cast("int").alias("d_source"),
        _name_place(F.col(lang_col)).cast("int").alias("d_lang"),
        F.monotonically_increasing_id().alias("rid"),
    )


class Tree:
    """Nodes by number: k shards each, and for split ones the dimension, cut key and children."""

    def __init__(self, shards: int):
        self.k, self.dim, self.cut, self.left, self.right, self.first = [shards], [-1], [0], [0], [0], [0]

    def split(self, i: int, dim: int, cut: int) -> None:
        kl = self.k[i] // 2
        for k, first in ((kl, self.first[i]), (self.k[i] - kl, self.first[i] + kl)):
            self.k.append(k)
            self.first.append(first)
            for xs in (self.dim, self.cut, self.left, self.right):
                xs.append(-1 if xs is self.dim else 0)
        self.dim[i], self.cut[i] = dim, cut
        self.left[i], self.right[i] = len(self.k) - 2, len(self.k) - 1

    def node(self) -> Column:
        """Leaf of a row that has ``key`` (array of the dimensions' keys)."""
        depth, level = 0, [0]
        while level:
            level = [c for i in level if self.dim[i] >= 0 for c in (self.left[i], self.right[i])]
            depth += bool(level)
        if not depth:
            return F.lit(0)
        dim, cut = _ints(self.dim), F.array(*[F.lit(x).cast("long") for x in self.cut])
        left, right = _ints(self.left), _ints(self.right)

        def step(n: Column, _: Column) -> Column:
            d = F.get(dim, n)
            return F.when(d < 0, n).when(F.get(F.col("key"), F.greatest(d, F.lit(0))) < F.get(cut, n),
                                         F.get(left, n)).otherwise(F.get(right, n))

        return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step)


def pack(heavy: list, shards: int, total: int) -> tuple[dict, list, list]:
    """Heavy groups (bytes, group) -> ({group: shard}, groups that fit nowhere, room left per shard)."""
    room, place, cut = [total / shards] * shards, {}, []
    for b, g in sorted(heavy, key=lambda x: (-x[0], x[1])):
        i = max(range(shards), key=lambda j: (room[j], -j))
        if b <= room[i]:
            place[g] = i
            room[i] -= b
        else:
            cut.append(g)
    return place, cut, room


def build(points: DataFrame, shards: int, slack: float = 0.01, room: list | None = None) -> Tree:
    """Tree over points (key array, bytes); ``room`` is each shard's share of them (default: equal)."""
    tree = Tree(shards)
    room = room or [1.0] * shards
    level = [0]
    while level:
        at = points.withColumn("node", tree.node()).filter(F.col("node").isin(*level))
        ext = at.groupBy("node").agg(
            F.sum("bytes").alias("bytes"),
            *[F.min(F.get("key", F.lit(d))).alias(f"lo{d}") for d in range(len(DIMS))],
            *[F.max(F.get("key", F.lit(d))).alias(f"hi{d}") for d in range(len(DIMS))]).collect()
        state = {}
        for r in ext:
            width = [(r[f"hi{d}"] >> TIE_BITS) - (r[f"lo{d}"] >> TIE_BITS) for d in range(len(DIMS))]
            dim = max(range(len(DIMS)), key=lambda d: (width[d], -d))
            i = r["node"]
            here = room[tree.first[i]:tree.first[i] + tree.k[i]]
            share = sum(here[:tree.k[i] // 2]) / sum(here) if sum(here) > 0 else 0.5
            state[i] = {"dim": dim, "want": r["bytes"] * share, "before": 0, "prefix": 0,
                        "leaf": r["bytes"] / tree.k[i], "cut": None}
        for i in level:
            if i not in state:  # nothing in it: any cut will do
                state[i] = {"dim": 0, "cut": 0}
        shift = VALUE_BITS + TIE_BITS
        while shift > 0 and (open_ := [i for i in level if state[i]["cut"] is None]):
            shift -= DIGIT
            size = max(open_) + 1
            dims = _ints([state[i]["dim"] if i in open_ else 0 for i in range(size)])
            prefix = F.array(*[F.lit(state[i]["prefix"] if i in open_ else -1).cast("long") for i in range(size)])
            key = F.get(F.col("key"), F.get(dims, F.col("node")))
            h = at.filter(F.col("node").isin(*open_)).select("node", "bytes", key.alias("k")).filter(
                F.shiftright("k", shift + DIGIT) == F.get(prefix, F.col("node")))
            rows = h.groupBy("node", F.shiftright("k", shift).alias("bin")).agg(
                F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
            for i in open_:
                s = state[i]
                acc = s["before"]
                for r in sorted((r for r in rows if r["node"] == i), key=lambda r: r["bin"]):
                    if acc + r["bytes"] >= s["want"]:
                        if shift and r["n"] > 1 and r["bytes"] > slack * s["leaf"]:
                            s["before"], s["prefix"] = acc, r["bin"]
                        else:  # the nearer side of a light bin
                            over = acc + r["bytes"] - s["want"] <= s["want"] - acc
                            s["cut"] = (r["bin"] + over) << shift
                        break
                    acc += r["bytes"]
        nxt = []
        for i in level:
            tree.split(i, state[i]["dim"], state[i]["cut"] or 0)
            nxt += [c for c in (tree.left[i], tree.right[i]) if tree.k[c] > 1]
        level = nxt
    return tree


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source", lang_col: str = "lang", rows_per_run: int = 500_000) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    meta = materialize(_meta(docs, id_col, text_col, source_col, lang_col), "kd-meta")
    group = ["th", "text_crc32", "size"]
    known = meta.agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("lo"),
                     F.max("doc_id").alias("hi")).first()
    total, n, lo, hi = known["b"] or 0, known["n"], known["lo"] or 0, known["hi"] or 0
    piece_bytes = max(1, total // (8 * shards))
    big = meta.groupBy(*group).agg(F.sum("size").alias("b")).filter(F.col("b") > piece_bytes)
    heavy = [(r["b"], (r["th"], r["text_crc32"], r["size"])) for r in big.collect()]  # fewer than 8 x shards + 1 groups
    place, cut, room = pack(heavy, shards, total)
    weight = {g: b for b, g in heavy}
    known_groups = docs.sparkSession.createDataFrame(
        [(*g, i, 1) for g, i in place.items()] + [(*g, None, -(-weight[g] // piece_bytes)) for g in cut],
        "th long, text_crc32 long, size long, packed int, pieces long")
    meta = meta.join(F.broadcast(known_groups), group, "left")
    meta = meta.withColumn("piece", F.coalesce(F.pmod(F.xxhash64("rid", F.lit(1)), F.col("pieces")), F.lit(0))).drop("pieces")
    d_id = (F.col("doc_id").cast("double") - F.lit(float(lo))) * (TOP / max(1, hi - lo))
    meta = meta.withColumn("d_id", F.coalesce(F.least(F.lit(TOP), d_id.cast("int")), F.lit(0)))
    points = meta.filter("packed IS NULL").groupBy(*group, "piece").agg(F.sum("size").alias("bytes"), *[F.min(d).alias(d) for d in DIMS])
    tie = F.xxhash64("th", "text_crc32", "piece").bitwiseAND((1 << TIE_BITS) - 1)
    points = points.withColumn("key", F.array(*[
        F.shiftleft(F.col(d).cast("long"), TIE_BITS).bitwiseOR(tie) for d in DIMS])).drop(*DIMS)
    points = materialize(points, "kd-points")
    tree = build(points, shards, room=room) if n else Tree(1)
    placed = points.select(*group, "piece", F.get(_ints(tree.first), tree.node()).alias("shard"))
    out = meta.drop(*DIMS).join(placed, [*group, "piece"], "left").withColumn("shard", F.coalesce("packed", "shard"))

    runs = max(32, math.ceil(n / rows_per_run))
    out = out.withColumn("run", F.pmod(F.xxhash64("rid"), F.lit(runs)))
    counts = out.groupBy("shard", "run").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "run", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"))
    in_run = F.row_number().over(Window.partitionBy("shard", "run").orderBy("rid"))
    return out.join(counts, ["shard", "run"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("c0") + in_run - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
