"""Exact removal of repeated word windows, found through difference-cover anchors.

A word goes if a window of ``length`` words that covers it also starts somewhere else, in the same document or another.

1. Anchors.  D is a difference cover modulo ``period``: for any two places i and j some k < period brings both i + k and
   j + k to places that are in D modulo ``period``.  Only there the hash of ``length - period + 1`` words is taken.  Two equal
   windows therefore hold equal anchors at the same offset.
2. One shuffle by anchor hash.  An anchor's context is all words that a window around it can reach.  Anchors with
   equal contexts repeat with everything in it.  Where contexts of one anchor hash differ, the anchors are candidates, one
   for each context.
3. Extension.  Around a candidate every window that contains it is hashed whole (two independent 64-bit hashes) and
   windows are counted in one more shuffle; windows with equal hashes repeat.

A batch sends one row for each anchor hash (or window) to a shuffle, so that a passage in a third of all documents is one row a
batch, and what repeats inside a batch is settled there.  Equality always rests on 128 bits: two hashes of the same words.

Defined cases: NULL text counts as empty; texts shorter than ``length`` words keep all; overlaps count; equal rows (repeated
ids included) are occurrences of each other; NULL ids are keyed by their text; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortkit.llm.common import ranges, text_batches, text_or_empty
from cohortkit.session import materialize

BATCH = 4 << 20  # bytes of text that a task looks at together
_KEYS = ("cover-lane-one-0", "cover-lane-two-1")
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
ROWS = "h long, c long, state byte, id long, th long, a int, b int"
#: ``state`` of a row: found once in its batch, several times, with several contexts; a span settled in the batch; a candidate.
ONCE, AGAIN, MIXED, SPAN, CANDIDATE = range(5)


def difference_cover(period: int) -> list[int]:
    """A smallest set whose pairwise differences give every number modulo ``period``."""
    def grow(chosen: list[int], size: int) -> list[int] | None:
        seen = {(x - y) % period for x in chosen for y in chosen}
        if len(seen) == period:
            return chosen
        left = size - len(chosen)
        # each further member adds at most two differences to each one chosen before it
        if len(seen) + sum(2 * (len(chosen) + i) for i in range(left)) < period:
            return None
        for x in range(chosen[-1] + 1, period) if left else ():
            found = grow([*chosen, x], size)
            if found:
                return found
        return None

    size = 1
    while True:
        found = grow([0], size)
        if found:
            return found
        size += 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """Hashes of any run of words in a concatenation of texts."""

    def __init__(self, words: list[bytes]):
        codes, uniq = pd.factorize(np.array(words, dtype=object)) if words else (np.zeros(0, np.int64), [])
        self.lanes = []
        n = len(words)
        for key, base in zip(_KEYS, _BASES):
            one = pd.util.hash_array(np.asarray(uniq, dtype=object), hash_key=key, categorize=False)[codes] if n else np.zeros(0, np.uint64)
            up, down = (np.full(n + 1, x, np.uint64) for x in (base, pow(base, -1, 1 << 64)))
            up[0] = down[0] = 1
            up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(_mix(one) * up[:n], out=total[1:])
            self.lanes.append((total, down))

    def of(self, lane: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        total, down = self.lanes[lane]
        return _mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def _words(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """All words, and each text's first word and number of words."""
    per = [t.encode().split() for t in texts]  # splits at the six ASCII white-space bytes
    lens = np.fromiter(map(len, per), np.int64, len(per))
    return [w for ws in per for w in ws], np.cumsum(lens) - lens, lens


def merged(own: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of overlapping or touching spans [a, b) of the same owner."""
    if not len(a):
        return own, a, b
    o = np.lexsort((a, own))
    own, a, b = own[o], a[o], b[o]
    shift = own * (int(b.max()) + 1)  # one line for all owners, so that one running maximum serves them
    reach = np.maximum.accumulate(b + shift)
    new = np.concatenate([[True], (own[1:] != own[:-1]) | ((a + shift)[1:] > reach[:-1])])
    last = np.concatenate([new[1:], [True]])
    return own[new], a[new], (reach - shift)[last]


def _rows(b: pa.RecordBatch, h, c, own, pos, lo, hi, contexts: bool) -> pa.RecordBatch:
    """Rows of a batch's anchors (``contexts``) or windows: hashes h and c, place ``pos`` in text ``own``, span lo to hi."""
    o = np.lexsort((c, h))
    hs, cs = h[o], c[o]
    new_h = np.concatenate([[True], hs[1:] != hs[:-1]])
    new_c = new_h | np.concatenate([[True], cs[1:] != cs[:-1]])
    first = np.flatnonzero(new_c)
    size = np.diff(np.append(first, len(o)))
    rep = o[first]
    group = np.cumsum(new_h)[first] - 1
    mixed = (np.bincount(group) > 1)[group] if contexts else np.zeros(len(rep), bool)
    lead = mixed & new_h[first]
    sent = np.concatenate([rep[~mixed], rep[lead]])
    state = np.concatenate([np.where(size[~mixed] > 1, AGAIN, ONCE), np.full(lead.sum(), MIXED)])
    many = o[np.repeat(size > 1, size)]
    who, x, y = merged(own[many], lo[many], hi[many])
    cand = rep[mixed]
    none = np.zeros(len(cand) + len(who), np.int64)
    take = np.concatenate([own[sent], own[cand], who])
    spread = _mix((take[len(sent):] * 1000003 + np.concatenate([pos[cand], x])).astype(np.uint64)).view(np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([h[sent].view(np.int64), spread])),
         pa.array(np.concatenate([c[sent].view(np.int64), none])),
         pa.array(np.concatenate([state, np.full(len(cand), CANDIDATE), np.full(len(who), SPAN)]).astype(np.int8)),
         b.column(0).take(pa.array(take)), b.column(1).take(pa.array(take)),
         pa.array(np.concatenate([pos[sent], pos[cand], x]).astype(np.int32)),
         pa.array(np.concatenate([np.zeros(len(sent) + len(cand), np.int64), y]).astype(np.int32))],
        ["h", "c", "state", "id", "th", "a", "b"])


def anchor_rows(keyed: DataFrame, length: int, period: int) -> DataFrame:
    """Rows of the anchors of (id, th, text): c is the hash of an anchor's context."""
    cover = np.zeros(period, bool)
    cover[difference_cover(period)] = True
    reach, width = period - 1, length - period + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches, "text", BATCH):
            words, starts, lens = _words(b.column(2).to_pylist())
            own = np.flatnonzero(lens >= length)
            own = np.repeat(own, lens[own] - width + 1)
            if not len(own):
                continue
            at = ranges(*(lambda k: (starts[k], lens[k] - width + 1))(np.flatnonzero(lens >= length)))
            pos = at - starts[own]
            on = cover[pos % period]
            own, at, pos = own[on], at[on], pos[on]
            x = WordHashes(words)
            lo, hi = np.maximum(pos - reach, 0), np.minimum(pos + width + reach, lens[own])
            c = x.of(1, starts[own] + lo, starts[own] + hi) ^ _mix((pos - lo).astype(np.uint64))
            yield _rows(b, x.of(0, at, at + width), c, own, pos, lo, hi, contexts=True)

    return keyed.mapInArrow(run, ROWS)


def window_rows(texts: DataFrame, length: int, period: int) -> DataFrame:
    """Rows of all windows that hold one of the candidates of (id, th, text, places): h and c are a window's two hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches, "text", BATCH):
            words, starts, lens = _words(b.column(2).to_pylist())
            place = b.column(3)
            own = np.repeat(np.arange(len(lens)), np.asarray(pa.compute.list_value_length(place)))
            p = np.asarray(place.flatten()).astype(np.int64)
            lo, hi = np.maximum(p - period + 1, 0), np.minimum(p, lens[own] - length)
            own, lo, hi = merged(own, lo, hi + 1)
            s = ranges(lo, hi - lo)
            if not len(s):
                continue
            own = np.repeat(own, hi - lo)
            x = WordHashes(words)
            at = starts[own] + s
            yield _rows(b, x.of(0, at, at + length), x.of(1, at, at + length), own, s, s, s + length, contexts=False)

    return texts.mapInArrow(run, ROWS)


def resolve(rows: DataFrame, before: int, after: int) -> DataFrame:
    """(id, th, a, b, candidate): spans that repeat, and anchors whose windows have to be compared.

    A settled row's span runs from ``before`` words before its place to ``after`` words after it.
    """
    w = Window.partitionBy("h").orderBy("c", F.desc("state"), "id", "th", "a")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    real = F.col("state") <= MIXED
    key = F.when(F.col("state") < MIXED, F.col("c"))
    r = rows.select(
        "*", F.min(key).over(whole).alias("c0"), F.max(key).over(whole).alias("c1"),
        F.max(F.when(real, F.col("state"))).over(whole).alias("most"),
        F.sum(F.when(real, 1).otherwise(0)).over(whole).alias("rows"),
        F.when(F.lag("state").over(w) < MIXED, F.lag("c").over(w)).alias("prior"),
        F.when(F.lead("state").over(w) < MIXED, F.lead("c").over(w)).alias("next"))
    r = r.filter((F.col("rows") > 1) | ~real)
    plain = F.col("state") < MIXED
    alike = F.coalesce(F.col("c") == F.col("prior"), F.lit(False))
    # of one class the rows that stand for it (ONCE, AGAIN) follow each other: the others sort before them
    settled = (F.col("state") == ONCE) & (alike | F.coalesce(F.col("c") == F.col("next"), F.lit(False)))
    differ = plain & ~alike & ((F.col("c0") != F.col("c1")) | (F.col("most") == MIXED))
    r = r.filter(settled | differ | ~F.col("state").isin(ONCE, AGAIN, MIXED))
    span = F.when(F.col("state") == SPAN, F.struct("a", "b")).when(
        settled, F.struct((F.col("a") - before).alias("a"), (F.col("a") + after).alias("b")))
    cand = F.when((F.col("state") == CANDIDATE) | differ, F.col("a"))
    return r.select("id", "th", span.alias("span"), cand.alias("candidate"))


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, text); th is the text's hash if ids repeat or are NULL, else 0 (which takes no room in a shuffle)."""
    d = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(F.col(text_col)).alias("text"))
    once = d.groupBy("id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1 or id is null").isEmpty()
    return d.select("id", (F.lit(0).cast("long") if once else F.xxhash64("text")).alias("th"), "text")


def _with_lists(keyed: DataFrame, lists: DataFrame, col: str, how: str) -> DataFrame:
    k, p = keyed.alias("k"), lists.alias("p")
    return k.join(p, F.col("k.id").eqNullSafe(F.col("p.id")) & (F.col("k.th") == F.col("p.th")), how).select(
        "k.id", "k.th", "text", col)


def repeated_spans(keyed: DataFrame, length: int, period: int) -> DataFrame:
    """Materialized (id, th, spans): word spans [a, b) that go, of texts keyed by (id, th); they may overlap and overrun."""
    width = length - period + 1
    found = materialize(resolve(anchor_rows(keyed, length, period), period - 1, width + period - 1), "cover-anchors")
    places = found.filter("candidate is not null").groupBy("id", "th").agg(F.collect_list("candidate").alias("places"))
    texts = _with_lists(keyed, places, "places", "inner")
    more = materialize(resolve(window_rows(texts, length, period), 0, length).filter("span is not null"), "cover-windows")
    both = found.select("id", "th", "span").unionByName(more.select("id", "th", "span")).filter("span is not null")
    return materialize(both.groupBy("id", "th").agg(F.collect_list("span").alias("spans")), "cover-spans", frees=(found, more))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 35,
                   period: int = 21) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept (words joined by one space, binary UTF-8)."""
    if not 1 <= period <= length:
        raise ValueError("period must lie between 1 and length")
    keyed = keyed_texts(docs, id_col, text_col)
    j = _with_lists(keyed, repeated_spans(keyed, length, period), "spans", "left")
    schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("n_words", T.LongType()),
                           T.StructField("n_removed", T.LongType()), T.StructField("kept", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches, "text", BATCH):
            out = []
            for t, spans in zip(b.column(2).to_pylist(), b.column(3)):
                words = t.encode().split()
                n = len(words)
                if spans.is_valid:
                    x, y = (np.asarray(spans.values.field(i)).astype(np.int64) for i in (0, 1))
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, np.maximum(x, 0), 1)
                    np.add.at(edge, np.minimum(y, n), -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:n]) == 0)]
                out.append((n, n - len(words), b" ".join(words)))
            cols = [pa.array(c, ty) for c, ty in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], schema.names)

    return j.mapInArrow(run, schema)


def digests(docs: DataFrame, **kw) -> DataFrame:
    d = remove_repeats(docs, **kw)
    return d.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
