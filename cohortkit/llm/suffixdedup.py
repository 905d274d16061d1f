"""Exact substring deduplication with suffix arrays built by two-stage sorting.

A byte goes if a string of ``length`` bytes that covers it also starts somewhere else.  A corpus is
too large for one suffix array, so places that can hold a repeat are first brought together:

1. Anchors.  In each window of ``length`` bytes the leftmost least hash of its ``GRAM``-byte strings is
   an anchor; equal windows have the same anchor.  An anchor's segment is every window it can be the anchor of.
   Segments whose anchor hash occurs once hold no repeat.
2. Equal segments (same anchor hash, same segment hash) repeat as a whole: all their bytes go.
3. Distinct segments of one anchor hash meet in a block.  The block's suffix array is built in two stages: suffixes
   smaller than their successor are sorted directly, the others are induced by scans of the buckets in order.
   Common prefixes of adjacent suffixes of at least ``length`` bytes are repeats.
4. An anchor hash with more than ``max_segments`` distinct segments is divided: each segment into eight
   narrower ranges of windows, grouped anew by the hash of what lies in every window of the range; parts alone in
   their group hold no repeat.  So on until groups are small or ranges are single windows.  Nothing is capped.

Rows are keyed by (id, text hash): rows equal in both are occurrences of each other and get the same spans.

Defined cases: NULL text counts as empty; texts shorter than ``length`` keep all bytes; overlaps count (a run of one
byte longer than ``length`` goes as a whole); NULL ids are keyed by their text; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortkit.llm.common import text_batches, text_or_empty
from cohortkit.session import materialize, release

GRAM = 48
_MASK = (1 << 64) - 1
_BASES = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1)


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    if n:
        p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Hashes of any substring of a buffer from prefix sums modulo 2^64."""

    _cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, buf: np.ndarray, lane: int = 0):
        n = len(buf)
        base = _BASES[lane]
        if lane not in self._cache or len(self._cache[lane][0]) < n + 1:
            size = max(n + 1, 1 << 20)
            self._cache[lane] = (_powers(base, size), _powers(pow(base, -1, 1 << 64), size))
        self.pow, self.inv = self._cache[lane]
        v = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(base))[buf]
        self.sum = np.zeros(n + 1, np.uint64)
        np.cumsum(v * self.pow[:n], out=self.sum[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sum[end] - self.sum[start]) * self.inv[start] + (end - start).astype(np.uint64))


def anchors(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, length: int) -> np.ndarray:
    """Places of the anchors of all windows inside the texts."""
    n = len(buf)
    m = n - length + 1
    if m < 1:
        return np.zeros(0, np.int64)
    grams = n - GRAM + 1
    at = np.arange(grams)
    h = Hashes(buf).of(at, at + GRAM)
    key = ((h >> np.uint64(33)) << np.uint64(32)).astype(np.int64) | at
    span, width = 1, length - GRAM + 1
    while span * 2 <= width:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    low = np.minimum(key[:m], key[width - span:width - span + m]) & 0xFFFFFFFF
    step = np.zeros(n + 1, np.int32)
    ok = lens >= length
    np.add.at(step, starts[ok], 1)
    np.add.at(step, (starts + lens - length + 1)[ok], -1)
    low = low[np.cumsum(step)[:m] > 0]
    if not len(low):
        return low
    fresh = np.concatenate([[True], low[1:] != low[:-1]])
    return np.unique(low[fresh])


ROWS = "h long, s long, n long, id long, th long, pos long, l short, r short, b long"


def anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """Anchors of (id, th, text) rows, and the spans that are settled where they are read.

    A batch is pre-aggregated: a segment found n times in it is one row (h, s, n, id, th, pos, l, r) of its first
    occurrence; with n > 1 all its occurrences repeat, and their spans come as rows with NULL h, from pos to ``b``
    (s then only spreads them).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = length - GRAM
        for b in text_batches(batches, "text", 1 << 20):
            texts = [t.encode() for t in b.column(2).to_pylist()]
            lens = np.fromiter(map(len, texts), np.int64, len(texts))
            buf = np.frombuffer(b"".join(texts), np.uint8)
            ends = np.cumsum(lens)
            starts = ends - lens
            at = anchors(buf, starts, lens, length)
            if not len(at):
                continue
            own = np.searchsorted(ends, at, side="right")
            left = np.minimum(reach, at - starts[own])
            right = np.minimum(reach, ends[own] - at - GRAM)
            x = Hashes(buf)
            h = x.of(at, at + GRAM)
            s = _mix(x.of(at - left, at + GRAM + right) ^ left.astype(np.uint64))
            o = np.lexsort((at, s, h))
            begin = np.concatenate([[True], (h[o][1:] != h[o][:-1]) | (s[o][1:] != s[o][:-1])])
            first = np.flatnonzero(begin)
            size = np.diff(np.concatenate([first, [len(o)]]))
            rep = o[first]
            again = np.sort(o[np.repeat(size > 1, size)])  # spans in order of place, touching ones merged
            a, e = at[again] - left[again], at[again] + GRAM + right[again]
            if len(a):
                # an anchor's segment may begin before and end after its neighbour's, never the reverse
                new = np.concatenate([[True], (a[1:] > np.maximum.accumulate(e)[:-1]) | (own[again][1:] != own[again][:-1])])
                lo = np.minimum.reduceat(a, np.flatnonzero(new))
                hi = np.maximum.reduceat(e, np.flatnonzero(new))
                who = own[again][new]
            else:
                lo = hi = who = np.zeros(0, np.int64)
            none = pa.nulls(len(lo), pa.int64())
            place = pa.array(np.concatenate([at[rep] - starts[own[rep]], lo - starts[who]]))
            take = pa.array(np.concatenate([own[rep], who]))
            pad = np.zeros(len(lo), np.int64)
            spread = _mix(np.concatenate([s[rep], lo.astype(np.uint64)]))[len(rep):]
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([pa.array(h[rep].view(np.int64)), none]),
                 pa.array(np.concatenate([s[rep], spread]).view(np.int64)), pa.array(np.concatenate([size, pad])),
                 b.column(0).take(take), b.column(1).take(take), place,
                 pa.array(np.concatenate([left[rep], pad]), pa.int16()), pa.array(np.concatenate([right[rep], pad]), pa.int16()),
                 pa.array(np.concatenate([np.zeros(len(rep), np.int64), hi - starts[who]]))],
                ["h", "s", "n", "id", "th", "pos", "l", "r", "b"])

    return docs.mapInArrow(run, ROWS)


def settled(rows: DataFrame) -> DataFrame:
    """One row per distinct segment (n: its occurrences), and a row with NULL h per span that repeats as a whole.

    One shuffle by segment, then a pass over sorted rows that holds one row of the segment at hand.  A segment has one row
    a batch at most, and a batch of 1 MB some 13,000 rows, so no segment is more than a small part of all rows.
    """
    def close(t: pa.Table, last: bool) -> tuple[pa.Table, pa.Table | None]:
        h, s, n = (np.asarray(t.column(c)) for c in ("h", "s", "n"))
        first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (s[1:] != s[:-1])]))
        total = np.add.reduceat(n, first)
        alone = np.flatnonzero((n == 1) & (np.repeat(total, np.diff(np.append(first, len(n)))) > 1))
        x = t.take(pa.array(alone))
        pos, left, right = (np.asarray(x.column(c)).astype(np.int64) for c in ("pos", "l", "r"))
        spans = pa.table([pa.nulls(len(alone), pa.int64()), x.column("s"), pa.array(np.zeros(len(alone), np.int64)),
                          x.column("id"), x.column("th"), pa.array(pos - left), x.column("l"), x.column("r"),
                          pa.array(pos + GRAM + right)], schema=t.schema)
        one = t.take(pa.array(first)).set_column(2, t.schema.field("n"), pa.array(total))
        if last:
            return pa.concat_tables([one, spans]), None
        # a segment that goes on has its occurrences so far settled if it has several, as n then says
        return pa.concat_tables([one.slice(0, len(one) - 1), spans]), one.slice(len(one) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = None
        for b in batches:
            t = pa.Table.from_batches([b])
            done = t.filter(pa.compute.is_null(t.column("h")))
            yield from done.to_batches()
            t = t.filter(pa.compute.is_valid(t.column("h")))
            if not len(t):
                continue
            t = t if open_ is None else pa.concat_tables([open_, t])
            out, open_ = close(t.combine_chunks(), last=False)
            yield from out.to_batches()
        if open_ is not None:
            yield from close(open_.combine_chunks(), last=True)[0].to_batches()

    return rows.repartition("h", "s").sortWithinPartitions("h", "s").mapInArrow(run, ROWS)


UNIT = 40  # bytes that one rank stands for: 5 doubled three times


def smaller_than_next(t: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than their successor (the last one counts as such)."""
    n = len(t)
    differs = np.concatenate([t[1:] != t[:-1], [True]])
    up = np.concatenate([t[1:] > t[:-1], [True]])
    # equal neighbours decide as the next different pair does
    at = np.minimum.accumulate(np.where(differs, np.arange(n), n)[::-1])[::-1]
    return up[at]


def _order(high: np.ndarray, low: np.ndarray, bits: int) -> np.ndarray:
    """Stable order of pairs of numbers below 2^bits: one sort of packed keys where they fit 64 bits."""
    n = len(high)
    if 2 * bits + max(1, n - 1).bit_length() <= 64:
        b = np.uint64(max(1, n - 1).bit_length())
        key = (high.astype(np.uint64) << np.uint64(bits) | low.astype(np.uint64)) << b | np.arange(n, dtype=np.uint64)
        key.sort()
        return (key & ((np.uint64(1) << b) - np.uint64(1))).astype(np.int64)
    return np.lexsort((low, high))


def unit_ranks(t: np.ndarray) -> np.ndarray:
    """Dense rank, from 1, of the UNIT bytes at each place (0 stands beyond the end)."""
    n = len(t)
    pad = np.concatenate([t, np.zeros(8, np.uint8)]).astype(np.int64)
    five = pad[:n] << 32 | pad[1:n + 1] << 24 | pad[2:n + 2] << 16 | pad[3:n + 3] << 8 | pad[4:n + 4]
    high, low, bits, span = five >> 20, five & (1 << 20) - 1, 20, 5
    while True:
        o = _order(high, low, bits)
        h, x = high[o], low[o]
        rank = np.empty(n, np.int64)
        rank[o] = np.cumsum(np.concatenate([[True], (h[1:] != h[:-1]) | (x[1:] != x[:-1])]))
        if span == UNIT:
            return rank
        high, low = rank, np.concatenate([rank[span:], np.zeros(min(span, n), np.int64)])[:n]
        bits, span = n.bit_length(), span * 2


def direct_sort(idx: np.ndarray, rank: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes ``idx`` in order of their first ``depth`` bytes at least: groups of equal ones are refined unit by unit."""
    n = len(rank)
    bits = n.bit_length()
    group = np.zeros(len(idx), np.int64)
    act = np.arange(len(idx))
    d = 0
    while d < depth and len(act):
        at = idx[act] + d
        word = np.where(at < n, rank[np.minimum(at, n - 1)], 0)
        o = _order(group[act], word, bits)
        idx[act] = idx[act][o]
        g, word = group[act], word[o]
        begin = np.concatenate([[True], (g[1:] != g[:-1]) | (word[1:] != word[:-1])])
        first = np.flatnonzero(begin)
        size = np.diff(np.concatenate([first, [len(act)]]))
        group[act] = np.repeat(act[first], size)
        act = act[np.repeat(size > 1, size)]
        d += UNIT
    return idx


def suffix_array(t: np.ndarray, rank: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``t`` in order of their first ``depth`` bytes at least, by two-stage sorting."""
    direct = direct_sort(np.flatnonzero(smaller_than_next(t)), rank, depth)
    first = np.searchsorted(t[direct], np.arange(257))
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        own = direct[first[c]:first[c + 1]]
        led = []
        if pending[c]:
            cur = np.concatenate(pending[c])
            while len(cur):  # runs of the same byte
                led.append(cur)
                p = cur[cur > 0] - 1
                cur = p[t[p] == c]
        full = np.concatenate([*led, own])
        out.append(full)
        prev = full[full > 0] - 1
        byte = t[prev]
        prev, byte = prev[byte > c], byte[byte > c]
        if len(prev):
            o = np.argsort(byte, kind="stable")
            prev, byte = prev[o], byte[o]
            cut = np.flatnonzero(byte[1:] != byte[:-1]) + 1
            for part, b in zip(np.split(prev, cut), byte[np.concatenate([[0], cut])].tolist()):
                pending[b].append(part)
    return np.concatenate(out)


def common_prefixes(sa: np.ndarray, rank: np.ndarray, most: int) -> np.ndarray:
    """Whole units that each suffix shares with the one before it, in bytes; ``most`` if the first ``most`` bytes agree."""
    lcp = np.zeros(len(sa), np.int32)
    act = np.arange(1, len(sa))
    for d in [*range(0, most - UNIT, UNIT), most - UNIT]:
        same = rank[sa[act - 1] + d] == rank[sa[act] + d]
        lcp[act[~same]] = d
        act = act[same]
    lcp[act] = most
    return lcp


def repeats(segments: list[bytes], place: np.ndarray, many: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(segment, start, end) of maximal runs covered by strings of ``length`` bytes that start elsewhere too.

    place: number of the first byte, the same for the same byte of the corpus; many: the segment occurs
    more than once (its strings repeat already, and it is not reported).
    """
    lens = np.fromiter(map(len, segments), np.int64, len(segments))
    t = np.frombuffer(b"\0".join(s.replace(b"\0", b"\xff") for s in segments) + b"\0", np.uint8)  # 0xFF is not in UTF-8
    starts = np.cumsum(lens + 1) - lens - 1
    rank = unit_ranks(t)
    sa = suffix_array(t, rank, length)
    seg = np.searchsorted(starts, sa, side="right") - 1
    off = sa - starts[seg]
    long = lens[seg] - off >= length
    sa, seg, off = sa[long], seg[long], off[long]
    if not len(sa):
        return []
    lcp = common_prefixes(sa, rank, length)
    opens = np.flatnonzero(lcp < length)
    where = place[seg] + off
    again = (np.minimum.reduceat(where, opens) != np.maximum.reduceat(where, opens)) | np.logical_or.reduceat(many[seg], opens)
    hit = np.repeat(again, np.diff(np.concatenate([opens, [len(sa)]]))) & ~many[seg]
    seg, off = seg[hit], off[hit]
    o = np.lexsort((off, seg))
    seg, off = seg[o], off[o]
    if not len(seg):
        return []
    new = np.concatenate([[True], (seg[1:] != seg[:-1]) | (off[1:] > off[:-1] + length)])
    last = np.concatenate([new[1:], [True]])
    return list(zip(seg[new].tolist(), off[new].tolist(), (off[last] + length).tolist()))


GROUP = ["g", "glo", "ghi"]
SPAN = "id long, th long, a long, b long"


def _places(id_: list, th: list, pos: np.ndarray) -> np.ndarray:
    """The same number for the same byte of the same document."""
    code: dict = {}
    return np.array([code.setdefault(k, len(code)) for k in zip(id_, th)], np.int64) * (1 << 40) + pos


def block_spans(units: DataFrame, length: int, block_bytes: int) -> DataFrame:
    """Spans of units (distinct segments) found by suffix arrays of blocks that hold whole groups."""
    total = units.agg(F.sum(F.length("seg")).alias("b")).first()["b"] or 0
    blocks = max(1, math.ceil(total / block_bytes))

    def run(tab: pa.Table) -> pa.Table:
        segs = tab.column("seg").to_pylist()
        id_, th = tab.column("id").to_pylist(), tab.column("th").to_pylist()
        pos = np.asarray(tab.column("pos")).astype(np.int64)
        many = np.asarray(tab.column("n")) > 1
        found = repeats(segs, _places(id_, th, pos), many, length)
        k = [f[0] for f in found]
        p = pos[k]
        return pa.table({"id": pa.array([id_[i] for i in k], pa.int64()), "th": pa.array([th[i] for i in k], pa.int64()),
                         "a": pa.array(p + np.array([f[1] for f in found], np.int64)),
                         "b": pa.array(p + np.array([f[2] for f in found], np.int64))})

    u = units.withColumn("blk", F.pmod(F.xxhash64(*GROUP), F.lit(blocks)))
    return u.select("blk", "n", "id", "th", "pos", "seg").groupBy("blk").applyInArrow(run, SPAN)


def ranges(units: DataFrame, length: int, which: Column | None = None, parts: int = 8) -> DataFrame:
    """A row per unit and narrower range of window starts (``x`` to ``y``, relative to the anchor) that holds windows of it
    (``px`` to ``py``); ``which`` of the ``parts`` ranges, or all.

    ``lo`` is the window start at a unit's first byte.  ``core`` hashes the unit's group and the bytes that lie in every window of
    the range: units that share a window of the range share it.
    """
    d = units.withColumn("step", F.ceil((F.col("ghi") - F.col("glo") + 1) / parts))
    d = d.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)) if which is None else which))
    d = d.withColumn("x", F.col("glo") + F.col("k") * F.col("step"))
    d = d.withColumn("y", F.least("ghi", F.col("x") + F.col("step") - 1))
    d = d.withColumn("px", F.greatest("x", "lo"))
    d = d.withColumn("py", F.least("y", F.col("lo") + F.length("seg") - length)).filter("px <= py")
    return d.withColumn("core", F.expr(f"xxhash64(g, substring(seg, int(y - lo + 1), int(x + {length} - y)))"))


def divide(units: DataFrame, length: int) -> DataFrame:
    """Units (numbered by ``u``) cut into narrower ranges, grouped by their cores; parts alone in their group are left out.

    Only numbers are shuffled to find the groups; bytes of the parts that are not alone follow.  s of a part is the hash of its
    bytes and place in the range.
    """
    found = materialize(ranges(units, length).select("u", "k", F.col("core").alias("g"), F.col("x").alias("glo"),
                                                     F.col("y").alias("ghi")), "sa-ranges")
    shared = found.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    which = found.join(shared, GROUP, "left_semi").groupBy("u").agg(F.collect_list("k").alias("ks"))
    d = ranges(units.join(which, "u"), length, F.col("ks"))
    d = d.withColumn("seg", F.expr(f"substring(seg, int(px - lo + 1), int(py - px + {length}))"))
    d = d.select(F.col("core").alias("g"), F.col("x").alias("glo"), F.col("y").alias("ghi"),
                 F.xxhash64("seg", F.col("px") - F.col("x")).alias("s"), "n", "id", "th",
                 (F.col("pos") + F.col("px") - F.col("lo")).alias("pos"), F.col("px").alias("lo"), "seg")
    return materialize(d, "sa-parts", frees=(found,))


def _spans(rows: DataFrame, a, b) -> DataFrame:
    return rows.select("id", "th", a.cast("long").alias("a"), b.cast("long").alias("b"))


def repeated_spans(keyed: DataFrame, length: int = 200, max_segments: int = 4000,
                   block_bytes: int = 1 << 20, unique: bool = False) -> DataFrame:
    """(id, th, a, b): spans whose bytes go, of texts keyed by (id, th); spans may overlap.  unique: no key repeats."""
    read = materialize(settled(anchor_rows(keyed, length)), "sa-segments")
    found = [materialize(_spans(read.filter("h is null"), F.col("pos"), F.col("b")), "sa-settled")]
    segments = read.filter("h is not null")
    mixed = segments.groupBy("h").agg(F.count(F.lit(1)).alias("d")).filter("d > 1").select("h")
    reps = segments.select("h", "n", "id", "th", "pos", "l", "r").join(mixed, "h")
    per_text = reps.groupBy("id", "th").agg(F.collect_list(F.struct("h", "n", "pos", "l", "r")).alias("us"))
    k = keyed.alias("k").join(per_text.alias("p"), F.col("k.id").eqNullSafe(F.col("p.id")) & (F.col("k.th") == F.col("p.th")))
    k = k.select("k.id", "k.th", F.encode("text", "UTF-8").alias("bytes"), "us")
    k = k if unique else k.dropDuplicates(["id", "th"])
    k = k.select("id", "th", "bytes", F.explode("us").alias("u"))
    reach = length - GRAM
    units = k.select(
        F.col("u.h").alias("g"), F.lit(-reach).cast("long").alias("glo"), F.lit(0).cast("long").alias("ghi"),
        F.lit(0).cast("long").alias("s"), F.col("u.n").alias("n"), "id", "th", (F.col("u.pos") - F.col("u.l")).alias("pos"),
        (-F.col("u.l")).cast("long").alias("lo"),
        F.expr(f"substring(bytes, int(u.pos - u.l + 1), int(u.l + {GRAM} + u.r))").alias("seg"))
    stage = units = materialize(units, "sa-units", frees=(read,))
    whole = True  # every group of whole segments has two or more, of their parts not
    while True:
        sizes = units.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("d"))
        # written: few and narrow, so the engine sees the size and need not shuffle the segments for this join
        large = materialize(sizes.filter((F.col("d") > max_segments) & (F.col("glo") < F.col("ghi"))).drop("d"), "sa-large")
        small = units.join(large, GROUP, "left_anti") if whole else units.join(
            sizes.filter(F.col("d").between(2, max_segments)).drop("d"), GROUP, "left_semi")
        found.append(materialize(block_spans(small, length, block_bytes), "sa-spans"))
        whole = False
        if large.isEmpty():
            release(stage, large)
            return reduce(DataFrame.unionByName, found)
        big = units.join(large, GROUP, "left_semi").withColumn("u", F.monotonically_increasing_id())
        big = materialize(big, "sa-big", frees=(stage, large))
        parts = divide(big, length)
        release(big)
        same = parts.groupBy(*GROUP, "s").agg(F.sum("n").alias("m"), F.first(F.struct("id", "th", "pos", "lo", "seg")).alias("u"))
        same = materialize(same, "sa-same")
        twice = parts.filter("n = 1").join(same.filter("m > 1").select(*GROUP, "s"), [*GROUP, "s"], "left_semi")
        found.append(materialize(_spans(twice, F.col("pos"), F.col("pos") + F.length("seg")), "sa-spans", frees=(parts,)))
        stage, units = same, same.select(*GROUP, "s", F.col("m").alias("n"), "u.*")


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """(id, th, text), and whether no key repeats; th is the text's hash if ids repeat or are NULL, else 0 (narrow rows)."""
    d = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(F.col(text_col)).alias("text"))
    once = d.groupBy("id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1 or id is null").isEmpty()
    return d.select("id", (F.lit(0).cast("long") if once else F.xxhash64("text")).alias("th"), "text"), once


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200,
                   max_segments: int = 4000, block_bytes: int = 1 << 20) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept (binary)."""
    keyed, once = keyed_texts(docs, id_col, text_col)
    spans = repeated_spans(keyed, length, max_segments, block_bytes, unique=once)
    lists = spans.groupBy("id", "th").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    j = keyed.alias("k").join(lists.alias("l"), F.col("k.id").eqNullSafe(F.col("l.id")) & (F.col("k.th") == F.col("l.th")),
                              "left").select("k.id", "text", "spans")
    schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
                           T.StructField("kept", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches, "text", 4 << 20):
            out = []
            for t, sp in zip(b.column(1).to_pylist(), b.column(2)):
                raw = t.encode()
                runs = merged(sp.values) if sp.is_valid else []
                kept, at = [], 0
                for x, y in runs:
                    kept.append(raw[at:x])
                    at = y
                kept.append(raw[at:])
                out.append((len(raw), sum(y - x for x, y in runs), len(runs), b"".join(kept)))
            cols = [pa.array(c, ty) for c, ty in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], schema.names)

    return j.mapInArrow(run, schema)


def merged(spans: pa.StructArray) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans."""
    a, b = np.asarray(spans.field(0)), np.asarray(spans.field(1))
    o = np.argsort(a, kind="stable")
    a, b = a[o], np.maximum.accumulate(b[o])
    new = np.concatenate([[True], a[1:] > b[:-1]])
    last = np.concatenate([new[1:], [True]])
    return list(zip(a[new].tolist(), b[last].tolist()))


def digests(docs: DataFrame, **kw) -> DataFrame:
    d = remove_repeats(docs, **kw)
    return d.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
