"""SimHash near-duplicates by covering locality-sensitive hashing.

A 64-bit fingerprint takes, per bit, the majority over the hashes of the text's
word shingles.  For radius r every bit position gets a non-zero vector of r + 1
bits; table v (each non-zero v) keeps the positions whose vector has an odd
product with v.  At most r differing positions span at most r dimensions, so some
v is orthogonal to all of them: in that table the pair agrees on every kept bit and
collides.  No pair within the radius is missed; what collides is compared exactly.

Equal fingerprints are one node before any table is built.  A bucket is read as a
sorted stream and its members compared block by block; only a spanning forest of
each comparison is emitted, never all pairs, and buckets larger than a block are
handed on as block pairs that run as tasks of their own (none is capped).  Components of the
links come from rounds of min-label contraction, each cut by a written table.

Defined cases: NULL and empty texts have fingerprint zero and link like any other;
fewer words than a shingle make one shingle of what is there; repeated rows and NULL
ids are kept (a component of NULL ids only has component_id NULL); an empty table
gives no rows; other columns are untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortkit.llm.common import text_batches
from cohortkit.session import materialize


def text_fingerprint(text: str, width: int = 4) -> int:
    """Unsigned fingerprint: a bit is 1 if set in over half the shingle hashes."""
    import xxhash

    words = text.encode("utf-8").lower().split()  # bytes: only A-Z fold, only ASCII white space parts
    if not words:
        return 0
    line = b" ".join(words)
    view = memoryview(line)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lens + 1) - lens - 1
    n = max(1, len(words) - width + 1)
    a = starts[:n].tolist()
    b = (starts + lens)[min(width, len(words)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(view[i:j], 42) for i, j in zip(a, b)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for s in range(0, n, 255 * 256):
        bit = np.unpackbits(h[s:s + 255 * 256].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bit) // 255 * 255  # sums of 255 bits fit a byte
        ones += bit[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bit[whole:].sum(axis=0, dtype=np.uint8)
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text_col: str = "text", width: int = 4, out: str = "fp") -> DataFrame:
    """All columns of ``docs`` but the text, and the fingerprint as a signed long."""
    rest = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches, text_col, 4 << 20):
            i = b.schema.get_field_index(text_col)
            fp = np.fromiter((text_fingerprint(t or "", width) for t in b.column(i).to_pylist()), np.uint64, b.num_rows)
            cols = [b.column(k) for k in range(b.num_columns) if k != i]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(fp.view(np.int64))], [*rest, out])

    fields = [docs.schema[c] for c in rest]
    return docs.select(*rest, text_col).mapInArrow(run, T.StructType([*fields, T.StructField(out, T.LongType())]))


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """2^(radius+1) - 1 masks; positions take the non-zero vectors of radius + 1 bits in turn."""
    span = (1 << (radius + 1)) - 1
    vec = [i % span + 1 for i in range(bits)]
    return [sum(1 << i for i in range(bits) if bin(vec[i] & v).count("1") % 2) for v in range(1, span + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


class _Forest:
    """Union-find over a block's rows."""

    def __init__(self, n: int):
        self.p = list(range(n))

    def find(self, i: int) -> int:
        p = self.p
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.p[max(i, j)] = min(i, j)
        return True


def forest_links(fps: np.ndarray, radius: int, split: int | None = None) -> tuple[list[int], list[int]]:
    """A spanning forest of the graph of pairs within ``radius`` (``split``: only pairs across that row)."""
    n = len(fps)
    f = _Forest(n)
    left, right = [], []
    u = fps.view(np.uint64)
    rows = n - 1 if split is None else split
    step = max(1, (1 << 20) // max(1, n))
    for s in range(0, rows, step):
        e = min(rows, s + step)
        lo = s + 1 if split is None else split
        d = np.bitwise_count(u[s:e, None] ^ u[None, lo:]) <= radius
        i, j = np.nonzero(d)
        i, j = i + s, j + lo
        ok = j > i
        for x, y in zip(i[ok].tolist(), j[ok].tolist()):
            if f.join(x, y):
                left.append(x)
                right.append(y)
    return left, right


def link_roots(nodes: DataFrame, radius: int = 4, block: int = 2048, col: str = "fp") -> DataFrame:
    """(node, root) of the components of all pairs of distinct fingerprints within ``radius``; unlinked nodes are absent."""
    masks = covering_masks(radius)
    each = [F.struct(F.lit(t).cast("short").alias("t"), F.col(col).bitwiseAND(F.lit(_signed(x)).cast("long")).alias("key"))
            for t, x in enumerate(masks)]
    keys = nodes.select(F.col(col).alias("fp"), F.explode(F.array(*each)).alias("k")).select("fp", "k.t", "k.key")
    size = keys.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = keys.repartition(int(size), "t", "key").sortWithinPartitions("t", "key", "fp")

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links inside blocks of a bucket; members of buckets beyond one block also as rows to pair blocks.

        A held block is flushed when full, so memory is one block whatever the bucket's size.
        """
        held = np.zeros((0,), np.int64)
        at, number = None, 0

        def out(a, b, t=None, key=None, blk=None):
            n = len(a)
            cols = [pa.array(a, pa.int64()), pa.array(b, pa.int64(), from_pandas=False),
                    pa.array([t] * n, pa.int16()), pa.array([key] * n, pa.int64()), pa.array([blk] * n, pa.int32())]
            return pa.RecordBatch.from_arrays(cols, ["a", "b", "t", "key", "blk"])

        def flush(full: bool):
            nonlocal held, number
            res = []
            if len(held) > 1:
                i, j = forest_links(held, radius)
                if i:
                    res.append(out(held[i], held[j]))
            if full or number:
                res.append(out(held, pa.nulls(len(held), pa.int64()), at[0], at[1], number))
                number += 1
            held = np.zeros((0,), np.int64)
            return res

        for batch in batches:
            fp = np.asarray(batch.column(0))
            t, key = np.asarray(batch.column(1)), np.asarray(batch.column(2))
            if not len(fp):
                continue
            cut = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
            starts = np.concatenate([[0], cut])
            ends = np.concatenate([cut, [len(fp)]])
            # buckets of one row inside the batch need no work
            single = (ends - starts == 1)
            single[[0, -1]] = False
            pairs = []
            for s, e in zip(starts[~single].tolist(), ends[~single].tolist()):
                now = (int(t[s]), int(key[s]))
                if now != at:
                    pairs += flush(False)
                    at, number = now, 0
                while s < e:
                    take = min(e - s, block - len(held))
                    held = np.concatenate([held, fp[s:s + take]])
                    s += take
                    if len(held) == block:
                        pairs += flush(True)
            if pairs:
                yield from pairs
        if at is not None:
            yield from flush(False)

    found = materialize(dealt.mapInArrow(buckets, "a long, b long, t short, key long, blk int"), "simhash-buckets")
    inside = found.filter("b is not null").select("a", "b")
    roots = components(inside)
    many = found.filter("b is null").select("t", "key", F.col("a").alias("node"), "blk")
    if many.isEmpty():
        return roots
    # large buckets whose members are in one component already have nothing to add
    many = many.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = many.groupBy("t", "key").agg(F.max("blk").alias("last"), F.min("root").alias("r0"), F.max("root").alias("r1"))
    open_ = open_.filter("r0 <> r1 and last > 0").drop("r0", "r1")
    m2 = materialize(many.join(open_, ["t", "key"]), "simhash-large")
    if m2.isEmpty():
        return roots
    # in the others each block meets every other block once
    as_left = m2.select("t", "key", "node", F.col("blk").alias("i"), F.explode(
        F.expr("if(blk < last, sequence(blk + 1, last), cast(array() as array<int>))")).alias("j"), F.lit(0).alias("side"))
    as_right = m2.select("t", "key", "node", F.explode(
        F.expr("if(blk > 0, sequence(0, blk - 1), cast(array() as array<int>))")).alias("i"),
        F.col("blk").alias("j"), F.lit(1).alias("side"))

    def across(tab: pa.Table) -> pa.Table:
        side, a = np.asarray(tab.column("side")), np.asarray(tab.column("node"))
        fps = np.concatenate([a[side == 0], a[side == 1]])
        i, j = forest_links(fps, radius, split=int((side == 0).sum()))
        return pa.table({"a": pa.array(fps[i], pa.int64()), "b": pa.array(fps[j], pa.int64())})

    crossed = as_left.unionByName(as_right).groupBy("t", "key", "i", "j").applyInArrow(across, "a long, b long")
    stars = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    return components(stars.unionByName(crossed))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b): root is the least node of its component.

    Each round hangs every node's larger neighbours, then its smaller ones, on the least node around
    it (alternating large-star and small-star), until a round changes nothing.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    e = materialize(e, "cc")
    mark = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that a join with a hot node is a plain one, which the engine can split
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), "cc-low")
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        large = materialize(large, "cc-large")
        low2 = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "cc-low")
        j = large.join(low2, "u")
        small = j.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low2.select("u", F.col("m").alias("v"))).distinct()
        e = materialize(small, "cc")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = 4,
                    radius: int = 4) -> DataFrame:
    """One row per document: id, fp, component_id (least id of all documents reachable by links)."""
    d = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    fp = materialize(fingerprints(d, "__text", width), "simhash")
    return fp.join(labels(fp, radius, id_col), "fp").select(id_col, "fp", "component_id")


def labels(fp: DataFrame, radius: int, id_col: str) -> DataFrame:
    """fp -> root (a fingerprint) and component_id, from rows of (id, fp)."""
    nodes = materialize(fp.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash-nodes")
    roots = link_roots(nodes, radius)
    r = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = r.groupBy("root").agg(F.min("least").alias("component_id"))
    return r.join(ids, "root").select("fp", "root", "component_id")


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = 4,
             radius: int = 4) -> DataFrame:
    """Rows of ``docs``, one of each component: that of the least id (of equal ids, the first stored)."""
    names = docs.columns
    staged = docs.withColumn("__rid", F.monotonically_increasing_id())
    staged = materialize(staged, "simhash-docs")  # row numbers must not change between reads
    fp = fingerprints(staged.select(F.col(id_col).alias("__id"), "__rid", F.col(text_col).alias("__text")), "__text", width)
    fp = materialize(fp, "simhash")
    lab = labels(fp, radius, "__id")
    # per fingerprint first, so that large groups of copies meet pre-aggregated
    least = fp.groupBy("fp").agg(F.min(F.struct(F.col("__id").isNull().alias("none"), "__id", "__rid")).alias("r"))
    keep = least.join(lab, "fp").groupBy("root").agg(F.min("r").alias("r")).select(F.col("r.__rid").alias("__rid"))
    return staged.join(keep, "__rid", "left_semi").select(*names)


def hex_fp(c):
    return F.lower(F.lpad(F.hex(c), 16, "0"))

