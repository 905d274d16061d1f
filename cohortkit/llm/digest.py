"""Improbable-feature digests of documents, and their likeness.

Every 64-byte window of a text has an entropy, quantised to 1,001 levels.  The
corpus says how rare each level is: level counts over all windows of all texts give
the rank of a level (rarest first; levels of almost constant windows take no part).
In each run of 64 successive windows the leftmost window of lowest rank scores a
point, and windows with ``popular`` points or more are the features of the text.  Each
feature sets five bits of a 2,048-bit Bloom filter; after ``per_filter`` features the next
filter of the chain begins.  The likeness of two filters is their bit overlap beyond chance, over the most there
could be; that of two digests is the mean, weighted by bits set, of each filter's best match
over the shorter chain.

Levels are integers and counts of windows exact, so a text's features do not depend on the batch it came in.

Defined cases: NULL text counts as empty; an empty text has the empty digest (alike to another
empty one: 1, else 0); a text shorter than a window is one feature; a text without a popular
window takes its most popular one; repeated ids are ordered by the text's hash, NULL ids come
last; a table of one row is its own next document; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortkit.llm.common import text_batches, text_or_empty
from cohortkit.operators.prefix import bucketize

WINDOW, RUN, BITS, LEVELS, TRIVIAL = 64, 64, 2048, 1000, 100
# c * log2(c) in 1/65536 bits; integers, so that sums telescope exactly
_CLOG = np.array([0] + [round(c * np.log2(c) * 65536) for c in range(1, WINDOW + 1)], np.int64)
_STEP = np.concatenate([[0], np.diff(_CLOG)])  # of the c-th equal byte
_FULL = int(_CLOG[WINDOW])


def entropy_levels(buf: np.ndarray) -> np.ndarray:
    """Quantised entropy (0 to 1000) of the window that starts at each byte."""
    n = len(buf)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    # how often a byte's value stands in the window that begins, and in the one that ends, with it:
    # one comparison per distance, on blocks that stay in the processor's cache
    ahead, behind = np.ones(n, np.uint8), np.ones(n, np.uint8)
    block = 1 << 15
    same = np.empty(block, np.uint8)
    for s in range(0, n, block):
        e = min(n, s + block)
        for d in range(1, WINDOW):
            m = min(e, n - d) - s
            if m <= 0:
                break
            eq = np.equal(buf[s:s + m], buf[s + d:s + d + m], out=same[:m].view(np.bool_)).view(np.uint8)
            ahead[s:s + m] += eq
            behind[s + d:s + d + m] += eq
    first = int(_CLOG[np.bincount(buf[:WINDOW], minlength=256)].sum())
    change = _STEP[behind[WINDOW:]] - _STEP[ahead[:n - WINDOW]]
    total = np.empty(n - WINDOW + 1, np.int64)
    total[0] = first
    np.cumsum(change, out=total[1:])
    total[1:] += first
    return (_FULL - total) * LEVELS // _FULL


def _join(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lens)
    return np.frombuffer(b"".join(texts), np.uint8), ends - lens, lens


def _valid(starts: np.ndarray, lens: np.ndarray, n: int) -> np.ndarray:
    """True where a whole window of one text starts (for the first n - WINDOW + 1 bytes)."""
    step = np.zeros(n + 1, np.int64)
    ok = lens >= WINDOW
    np.add.at(step, starts[ok], 1)
    np.add.at(step, (starts + lens - WINDOW + 1)[ok], -1)
    return np.cumsum(step)[:max(0, n - WINDOW + 1)] > 0


def level_counts(docs: DataFrame, text_col: str = "text") -> list[int]:
    """Windows per entropy level over every text of the corpus (1,001 counts reach the driver)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS + 1, np.int64)
        for b in text_batches(batches, "t", 1 << 20):
            buf, starts, lens = _join([(t or "").encode() for t in b.column(0).to_pylist()])
            lev = entropy_levels(buf)
            total += np.bincount(lev[_valid(starts, lens, len(buf))], minlength=LEVELS + 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["level", "n"])

    rows = docs.select(F.col(text_col).alias("t")).mapInArrow(run, "level int, n long").groupBy("level").agg(
        F.sum("n").alias("n")).collect()
    out = [0] * (LEVELS + 1)
    for r in rows:
        out[r["level"]] = int(r["n"])
    return out


def rank_levels(counts: list[int]) -> np.ndarray:
    """Rank of each level, rarest first; -1 for the levels of almost constant windows."""
    c = np.asarray(counts, np.int64)
    rank = np.empty(len(c), np.int64)
    rank[np.lexsort((np.arange(len(c)), c))] = np.arange(len(c))
    rank[:TRIVIAL] = -1
    return rank


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def digests(texts: list[bytes], rank: np.ndarray, popular: int = 16, per_filter: int = 128) -> list[np.ndarray]:
    """Chain of Bloom filters of each text, as an array (filters, 256) of bytes."""
    buf, starts, lens = _join(texts)
    n = len(buf)
    valid = _valid(starts, lens, n)
    m = len(valid)
    feature_at = np.zeros(0, np.int64)
    if m:
        r = rank[entropy_levels(buf)]
        usable = valid & (r >= 0)
        small = m < 1 << 20  # rank and place fit in 31 bits
        kind, shift = (np.int32, 20) if small else (np.int64, 32)
        none = kind(np.iinfo(kind).max)
        low = np.full(m + RUN, none, kind)
        low[:m] = np.where(usable, (r.astype(kind) << kind(shift)) + np.arange(m, dtype=kind), none)
        span = 1
        while span < RUN:  # least key of the next RUN windows, by doubling
            low[:-span] = np.minimum(low[:-span], low[span:])
            span *= 2
        won = low[:m][valid]
        won = won[won < none] & kind((1 << shift) - 1)
        points = np.bincount(won, minlength=m)
        picked = points >= popular
        ends = np.maximum(np.minimum(starts + lens - WINDOW + 1, m), 0)
        cum = np.concatenate([[0], np.cumsum(picked)])
        has = cum[np.maximum(ends, starts.clip(max=m))] - cum[starts.clip(max=m)] > 0
        for i in np.flatnonzero(~has & (lens >= WINDOW)):
            picked[starts[i] + int(np.argmax(points[starts[i]:ends[i]]))] = True
        feature_at = np.flatnonzero(picked)
    owner = np.searchsorted(starts + lens, feature_at, side="right")
    if len(feature_at):
        rows = np.lib.stride_tricks.sliding_window_view(buf, WINDOW)[feature_at]
        words = np.ascontiguousarray(rows).view(np.uint64)
        h = np.zeros(len(words), np.uint64)
        for j in range(words.shape[1]):
            h = _mix(h ^ words[:, j] + np.uint64(0x9E3779B97F4A7C15 * (j + 1) & (1 << 64) - 1))
    else:
        h = np.zeros(0, np.uint64)
    # texts shorter than a window are one feature
    short = np.flatnonzero((lens > 0) & (lens < WINDOW))
    if len(short):
        hs = np.array([int.from_bytes(hashlib.blake2b(texts[i], digest_size=8).digest(), "little") for i in short], np.uint64)
        owner, h = np.concatenate([owner, short]), np.concatenate([h, hs])
        o = np.argsort(owner, kind="stable")
        owner, h = owner[o], h[o]
    per_text = np.bincount(owner, minlength=len(texts)).astype(np.int64)
    n_filters = -(-per_text // per_filter)
    base = np.cumsum(n_filters) - n_filters
    within = np.arange(len(owner)) - (np.cumsum(per_text) - per_text)[owner]
    row = base[owner] + within // per_filter
    bits = np.zeros((int(n_filters.sum()), BITS), np.uint8)
    for j in range(5):
        bits[row, (h >> np.uint64(11 * j)).astype(np.int64) & (BITS - 1)] = 1
    packed = np.packbits(bits, axis=1)
    return [packed[b:b + k] for b, k in zip(base.tolist(), n_filters.tolist())]


def likeness(x: np.ndarray, y: np.ndarray, block: int = 256) -> float:
    """Normalised bit overlap of two filter chains, 0 to 1."""
    if not len(x) or not len(y):
        return 1.0 if len(x) == len(y) else 0.0
    if len(x) == len(y) and np.array_equal(x, y):
        return 1.0
    if len(x) > len(y):
        x, y = y, x
    both = len(x) == len(y)
    cx, cy = (np.bitwise_count(z).sum(axis=1, dtype=np.int64).astype(float) for z in (x, y))

    def one_way(p, q, cp, cq):
        parts = []
        for s in range(0, len(p), block):
            best = None
            for e in range(0, len(q), block):
                inter = np.bitwise_count(p[s:s + block, None] & q[None, e:e + block]).sum(axis=2, dtype=np.int64)
                chance = cp[s:s + block, None] * cq[None, e:e + block] / BITS
                most = np.minimum(cp[s:s + block, None], cq[None, e:e + block])
                sc = np.where(most > chance, (inter - chance) / np.maximum(most - chance, 1e-9), 1.0)
                sc = np.clip(sc, 0.0, 1.0).max(axis=1)
                best = sc if best is None else np.maximum(best, sc)
            parts.append(best)
        return float(np.average(np.concatenate(parts), weights=cp))

    a = one_way(x, y, cx, cy)
    return (a + one_way(y, x, cy, cx)) / 2 if both else a


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the head of the next document."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 8 << 20) -> DataFrame:
    """(bucket, edge, id, text) dealt and sorted so that a row's next document is the row after it.

    Buckets are ranges of ids, walked downwards.  Each also gets, as its last row with ``edge`` set, the
    first row of the bucket after it (of the first bucket, after the last).  The list of those heads has
    one row of two numbers per bucket and is broadcast.
    """
    d = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(F.col(text_col)).alias("text"))
    total = d.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    n = int(max(1, total // bucket_bytes))
    known = d.filter("id is not null").select(F.col("id").cast("double").alias("x"))
    cuts = known.approxQuantile("x", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    d = d.withColumn("x", F.col("id").cast("double"))
    d = bucketize(d, "x", [float("-inf"), *sorted(set(cuts)), float("inf")], "b").drop("x")
    # walked downwards, NULL ids last
    d = d.withColumn("bucket", F.when(F.col("id").isNull(), F.lit(1)).otherwise(-F.col("b").cast("int"))).drop("b")
    d = d.withColumn("th", F.xxhash64("text"))
    heads = d.groupBy("bucket").agg(F.max(F.struct(F.coalesce("id", F.lit(0)).alias("id"), "th")).alias("h"))
    order = Window.orderBy("bucket")
    heads = heads.select(
        F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(Window.partitionBy())).alias("to"),
        F.col("bucket").alias("hb"), F.col("h.id").alias("hid"), F.col("h.th").alias("hth"))
    edge = d.join(F.broadcast(heads), (d["bucket"] == heads["hb"]) & (F.coalesce(d["id"], F.lit(0)) == heads["hid"])
                  & (d["th"] == heads["hth"])).groupBy("to").agg(F.first("text").alias("text"))
    rows = d.select("bucket", F.lit(0).alias("edge"), "id", "th", "text").unionByName(
        edge.select(F.col("to").alias("bucket"), F.lit(1).alias("edge"), F.lit(None).cast("long").alias("id"),
                    F.lit(0).cast("long").alias("th"), "text"))
    parts = max(n, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, "bucket").sortWithinPartitions(
        "bucket", "edge", F.col("id").desc_nulls_last(), F.col("th").desc()).select("bucket", "edge", "id", "text")


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", popular: int = 16,
                      per_filter: int = 128) -> DataFrame:
    """Fingerprints of each text and of its edited text, and the likeness to the edited and the next document."""
    rank = rank_levels(level_counts(docs, text_col))
    schema = T.StructType([
        T.StructField(id_col, T.LongType()), T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()), T.StructField("n_filters", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (bucket, id, text, digest) still waiting for its next document
        for b in text_batches(batches, "text", 1 << 20):
            buckets, edges, ids, texts = (b.column(i).to_pylist() for i in range(4))
            own = digests([t.encode() for t in texts], rank, popular, per_filter)
            rows = list(zip(buckets, edges, ids, texts, own))
            before = ([held] if held else []) + rows[:-1]
            after = rows if held else rows[1:]
            held = rows[-1] if rows else held
            pairs = [(x, y) for x, y in zip(before, after) if not x[1]]
            if not pairs:
                continue
            new = [edited(x[3], y[3]).encode() for x, y in pairs]
            made = digests(new, rank, popular, per_filter)
            cols = [
                pa.array([x[2] for x, _ in pairs], pa.int64()),
                pa.array([len(x[3]) for x, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in new]),
                pa.array([x[4].tobytes().hex() for x, _ in pairs], pa.string()),
                pa.array([e.tobytes().hex() for e in made], pa.string()),
                pa.array([likeness(x[4], e) for (x, _), e in zip(pairs, made)], pa.float64()),
                pa.array([likeness(x[4], y[4]) for x, y in pairs], pa.float64()),
                pa.array([len(x[4]) for x, _ in pairs], pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, schema.names)

    return in_order(docs, id_col, text_col).mapInArrow(run, schema)
