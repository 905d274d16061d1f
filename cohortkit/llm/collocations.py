"""Phrase collocations counted on a prefix-free parse.

1. Parse.  A document's words (its piece ends are tokens too) are cut at content triggers: places where the hash of the next
   three tokens is 0 modulo ``spacing``.  A chunk runs from a trigger to the end of the next one, so neighbours share three
   tokens, equal passages give equal chunks wherever they stand, and any phrase of up to four words lies in one chunk.
2. Dictionary.  Distinct chunks with their frequencies in the parse, one shuffle.
3. Counts.  Phrases are counted inside distinct chunks, weighted by the chunks' frequencies.  A phrase belongs to the chunk
   in which it starts before the shared tokens, so overlaps are counted once.  A batch joins equal phrases by two 64-bit hashes
   before it sends their texts; the shuffle joins texts.
4. Levels.  All parts of a phrase that occurs ``least`` times occur that often.  Words, then pairs of such words, then phrases of
   3 and 4 words made of such pairs are counted by hash; hashes counted ``least`` times set bits in tables of fixed size.  Only texts
   of phrases with their bit set are sent and counted.  Hashes and tables may let rare phrases through (which their exact
   count drops), never hold back a frequent one.
5. Scores, containment and ranks are joins and windows over the frequent phrases; integers are exact (decimals of 38 digits).

Defined cases: NULL text counts as empty and has no words; NULL lang is ``und``; repeated rows count each; an empty table gives no
rows; a text without a trigger is one chunk; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortkit.llm.common import ranges, text_batches, text_or_empty
from cohortkit.session import materialize, shuffles_freed

LONGEST = 4  # words of a phrase; chunks share one less
SHARED = LONGEST - 1
BATCH = 4 << 20  # bytes of texts or chunks that a task looks at together
_END = b"."  # stands for any end of a piece; no word holds it
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 46 if bytes([c]) in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))
COUNTS = "lang string, phrase string, a long"


def tokens(text: str) -> list[bytes]:
    """Words with A-Z lower-cased, and ``_END`` where a piece ends."""
    return text.encode().translate(_FOLD).replace(_END, b" . ").split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def chunk_starts(words: list[bytes], starts: np.ndarray, lens: np.ndarray, spacing: int) -> np.ndarray:
    """Places of a concatenation of texts where a chunk begins: each text's start, and every trigger inside it."""
    n = len(words)
    one = np.fromiter(map(zlib.crc32, words), np.uint64, n)
    begin = np.zeros(n, bool)
    if n >= SHARED:
        h = np.zeros(n - SHARED + 1, np.uint64)
        for i in range(SHARED):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + one[i:n - SHARED + 1 + i])
        begin[:len(h)] = h % np.uint64(spacing) == 0
    for i in range(1, SHARED):  # a trigger lies inside its text
        last = (starts + lens - i)[lens >= i]
        begin[last] = False
    begin[starts[lens > 0]] = True
    return np.flatnonzero(begin)


def dictionary(docs: DataFrame, spacing: int) -> DataFrame:
    """(lang, chunk, last, times): distinct chunks of (lang, text), a space after each word; last: it ends its text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches, "text", BATCH):
            langs = b.column(0).to_pylist()
            per = [tokens(t) for t in b.column(1).to_pylist()]
            lens = np.fromiter(map(len, per), np.int64, len(per))
            words = [w for ws in per for w in ws]
            starts = np.cumsum(lens) - lens
            at = chunk_starts(words, starts, lens, spacing)
            own = np.searchsorted(starts + lens, at, side="right")
            end = np.append(at[1:], len(words))
            last = end == (starts + lens)[own]
            end = np.where(last, end, end + SHARED)
            found = Counter((langs[o], b" ".join(words[x:y]) + b" ", z)
                            for o, x, y, z in zip(own.tolist(), at.tolist(), end.tolist(), last.tolist()))
            keys = list(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.binary()),
                 pa.array([k[2] for k in keys], pa.bool_()), pa.array(list(found.values()), pa.int64())],
                ["lang", "chunk", "last", "times"])

    rows = docs.mapInArrow(run, "lang string, chunk binary, last boolean, times long")
    return rows.groupBy("lang", "chunk", "last").agg(F.sum("times").alias("times"))


class Bits:
    """A table of 2^size bits, one set for each phrase it was made of (and for others, by chance)."""

    def __init__(self, size: int, table: bytes):
        self.size, self.table = size, table

    def has(self, h: np.ndarray) -> np.ndarray:
        at = (h >> np.uint64(64 - self.size)).astype(np.int64)
        return np.frombuffer(self.table, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0


_LONG = 64  # bytes; a longer word's hash is a digest, as polynomials modulo 2^64 can be made to collide by long words
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_PART = 1 << 16
_kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _digest(word: bytes) -> np.ndarray:
    return np.frombuffer(hashlib.blake2b(word, digest_size=16).digest(), np.uint64)


class Words:
    """The words of a buffer of single spaces, each ended by one: first byte, end, and (``hashes``) two 64-bit hashes of each."""

    def __init__(self, buf: np.ndarray):
        self.buf = buf
        self.end = np.flatnonzero(buf == 32)
        self.start = np.concatenate([[0], self.end[:-1] + 1]) if len(self.end) else self.end

    def hashes(self, lane: int) -> np.ndarray:
        base = _BASES[lane]
        value = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(base))
        cut = np.unique(np.searchsorted(self.end, np.append(np.arange(0, len(self.buf), _PART), len(self.buf))))
        out = np.zeros(len(self.end), np.uint64)
        for i, j in zip(cut[:-1], cut[1:]):  # a part's arrays stay in the processor's cache
            a, b = self.start[i], self.end[j - 1]
            up, down = _powers(lane, b - a)
            total = np.zeros(b - a + 1, np.uint64)
            np.cumsum(value[self.buf[a:b]] * up[:b - a], out=total[1:])
            x, y = self.start[i:j] - a, self.end[i:j] - a
            out[i:j] = _mix((total[y] - total[x]) * down[x] + (y - x).astype(np.uint64))
        for w in np.flatnonzero(self.end - self.start > _LONG):
            out[w] = _digest(self.buf[self.start[w]:self.end[w]].tobytes())[lane]
        return out


def _powers(lane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a lane's base and of its inverse, n + 1 of them at least."""
    if lane not in _kept or len(_kept[lane][0]) <= n:
        both = []
        for x in (_BASES[lane], pow(_BASES[lane], -1, 1 << 64)):
            p = np.full(max(n + 1, 2 * _PART), x, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _kept[lane] = tuple(both)
    return _kept[lane]


def _fold(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase that goes on with ``word``; a phrase starts with its language's hash."""
    return _mix(h * np.uint64(0xD6E8FEB86659FD93) + word)


def _languages(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Number of each row's language, the languages, and their hashes (a row each)."""
    d = column.dictionary_encode()
    names = d.dictionary
    h = [_digest(x.encode()) for x in names.to_pylist()]
    return np.asarray(d.indices).astype(np.int64), names, np.stack(h) if h else np.zeros((0, 2), np.uint64)


def bits(hashes: DataFrame, size: int) -> Bits:
    """Bits of rows (h): distinct bit numbers are gathered to segments, and segments of known size to one table."""
    segment = min(size, 19)  # bits of a bit's number inside its segment

    def gather(t: pa.Table) -> pa.Table:
        at = np.asarray(t.column("bit"))
        one = np.zeros(1 << segment, bool)
        one[at & ((1 << segment) - 1)] = True
        return pa.table({"seg": pa.array(at[:1] >> segment), "part": pa.array([np.packbits(one, bitorder="little").tobytes()])})

    rows = hashes.select(F.shiftrightunsigned("h", 64 - size).alias("bit")).distinct()
    parts = rows.withColumn("seg", F.shiftright("bit", segment)).groupBy("seg").applyInArrow(gather, "seg long, part binary")
    table = bytearray(1 << size >> 3)
    for r in parts.collect():  # at most 2^(size - segment) rows of 64 KB
        table[r["seg"] << segment - 3:(r["seg"] + 1) << segment - 3] = r["part"]
    return Bits(size, bytes(table))


class Chunks:
    """A batch of the dictionary: words (read without a copy), first hashes, and each chunk's language and frequency."""

    def __init__(self, b: pa.RecordBatch):
        chunks = b.column(1)
        offsets = np.frombuffer(chunks.buffers()[1], np.int32, len(chunks) + 1, chunks.offset * 4)
        data = chunks.buffers()[2]
        self.words = x = Words((np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[offsets[0]:offsets[-1]])
        self.lens = np.diff(np.searchsorted(x.end, offsets - offsets[0]))
        self.lang, self.names, self.hashes = _languages(b.column(0))
        self.last, self.times = np.asarray(b.column(2).cast(pa.int8())) > 0, np.asarray(b.column(3))
        self.one = x.hashes(0)
        self.word = (x.end - x.start > 1) | (x.buf[x.start] != _END[0])

    def places(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and chunk of each phrase of n words: all places of a last chunk, else those before the shared tokens."""
        lens = self.lens
        room = np.maximum(np.where(self.last, lens - n + 1, np.minimum(lens - n + 1, lens - SHARED)), 0)
        at, own = ranges(np.cumsum(lens) - lens, room), np.repeat(np.arange(len(lens)), room)
        good = self.word[at]
        for i in range(1, n):
            good &= self.word[at + i]
        return at[good], own[good]

    def phrase_hashes(self, n: int) -> np.ndarray:
        """The hash of the n words from each word on (0 where there are fewer in the batch), in its chunk's language."""
        k = max(len(self.one) - n + 1, 0)
        h = self.hashes[np.repeat(self.lang, self.lens)[:k], 0]
        for i in range(n):
            h = _fold(h, self.one[i:k + i])
        return np.concatenate([h, np.zeros(len(self.one) - k, np.uint64)])


def count_hashes(chunks: DataFrame, sizes: tuple[int, ...], m: int = 0, parts: Bits | None = None) -> DataFrame:
    """(h, a): weights, summed by hash, of the phrases of ``sizes`` words whose phrases of m words are all in ``parts``."""
    shared = chunks.sparkSession.sparkContext.broadcast(parts) if parts else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches, "chunk", BATCH):
            c = Chunks(b)
            may = shared.value.has(c.phrase_hashes(m)) if shared else None
            for n in sizes:
                at, own = c.places(n)
                if shared:
                    good = may[at]
                    for i in range(1, n - m + 1):
                        good &= may[at + i]
                    at, own = at[good], own[good]
                if len(at):
                    h = c.phrase_hashes(n)[at]
                    o = np.argsort(h)
                    first = np.flatnonzero(np.concatenate([[True], h[o][1:] != h[o][:-1]]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h[o[first]].view(np.int64)), pa.array(np.add.reduceat(c.times[own][o], first))], ["h", "a"])

    return chunks.select("lang", "chunk", "last", "times").mapInArrow(run, "h long, a long").groupBy("h").agg(F.sum("a").alias("a"))


def _counted(c: Chunks, at: np.ndarray, own: np.ndarray, n: int, first_hash: np.ndarray) -> pa.RecordBatch:
    """Summed rows of the phrases of n words at ``at``, in chunks ``own``: joined by two hashes each."""
    x, lang = c.words, c.lang[own]
    used, where = np.unique(at[:, None] + np.arange(n), return_inverse=True)
    where = where.reshape(len(at), n)
    second = Words(x.buf[ranges(x.start[used], x.end[used] + 1 - x.start[used])]).hashes(1)
    p, q = first_hash[at], c.hashes[lang, 1]
    for i in range(n):
        q = _fold(q, second[where[:, i]])
    o = np.argsort(p)
    new = np.concatenate([[True], p[o][1:] != p[o][:-1]])
    if (q[o][1:] != q[o][:-1])[~new[1:]].any():  # equal first hashes of different phrases
        o = np.lexsort((q, p))
        new = np.concatenate([[True], (p[o][1:] != p[o][:-1]) | (q[o][1:] != q[o][:-1])])
    first = np.flatnonzero(new)
    a = np.add.reduceat(c.times[own][o], first)
    o = o[first]
    begin, length = x.start[at[o]], x.end[at[o] + n - 1] - x.start[at[o]]
    phrase = pa.StringArray.from_buffers(len(o), pa.py_buffer(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)),
                                         pa.py_buffer(x.buf[ranges(begin, length)]))
    return pa.RecordBatch.from_arrays([c.names.take(pa.array(lang[o])), phrase, pa.array(a)], ["lang", "phrase", "a"])


def count_phrases(chunks: DataFrame, tables: list[Bits]) -> DataFrame:
    """(lang, phrase, a) of the words in the first table, the pairs in the second, the phrases of 3 and 4 words in the third.

    The empty phrase's row of a language is its number of words.
    """
    shared = chunks.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        for b in text_batches(batches, "chunk", BATCH):
            c = Chunks(b)
            for n in range(1, LONGEST + 1):
                at, own = c.places(n)
                if n == 1:
                    total = np.zeros(len(c.names), np.int64)
                    np.add.at(total, c.lang[own], c.times[own])
                    yield pa.RecordBatch.from_arrays([c.names, pa.array([""] * len(total)), pa.array(total)], ["lang", "phrase", "a"])
                h = c.phrase_hashes(n)
                good = tables[min(n, 3) - 1].has(h)[at]
                if good.any():
                    yield _counted(c, at[good], own[good], n, h)

    rows = chunks.select("lang", "chunk", "last", "times").mapInArrow(run, COUNTS)
    return rows.groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


def frequent_phrases(docs: DataFrame, least: int, spacing: int, table_bits: int) -> DataFrame:
    """Materialized (lang, phrase, a) of 1 to 4 words with a >= least, and of the empty phrase (all words) a language."""
    chunks = materialize(dictionary(docs, spacing), "phrase-chunks")
    often = F.col("a") >= least
    tables: list[Bits] = []
    with shuffles_freed(docs.sparkSession):
        for sizes, m in (((1,), 0), ((2,), 1), ((3, 4), 2)):
            tables.append(bits(count_hashes(chunks, sizes, m, tables[-1] if tables else None).filter(often), table_bits))
    return materialize(count_phrases(chunks, tables).filter(often | (F.col("phrase") == "")), "phrases", frees=(chunks,))


def _exact(c: str):
    return F.col(c).cast("decimal(19,0)")


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, inside_percent: int = 80,
         top: int = 2000, spacing: int = 32, table_bits: int = 27) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of 2 to 4 words.

    spacing: mean number of tokens between triggers; table_bits: the level tables have 2^table_bits bits each.
    """
    d = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                    text_or_empty(F.col(text_col)).alias("text"))
    parts = frequent_phrases(d, least, spacing, table_bits)
    words = parts.filter("phrase = ''").select("lang", F.col("a").alias("n"))
    cands = parts.withColumn("ws", F.split("phrase", " "))
    cands = cands.withColumn("len", F.size("ws")).filter("len > 1")

    def joined(start, n):
        return F.concat_ws(" ", F.slice("ws", start, n))

    cut = cands.select("lang", "phrase", "a", "ws", "len", F.explode(F.sequence(F.lit(1), F.col("len") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("left"),
                     joined(F.col("k") + 1, F.col("len") - F.col("k")).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cut = cut.join(parts.select("lang", F.col("phrase").alias(side), F.col("a").alias(name)), ["lang", side])
    score = F.expr("cast(cast(a as decimal(19,0)) * 2000000 div (cast(l as decimal(19,0)) + cast(r as decimal(19,0))) as long)")
    best = cut.groupBy("lang", "phrase").agg(
        F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    subs = F.filter(F.flatten(F.transform(F.sequence(F.lit(2), F.col("len") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("len") - m + 1), lambda i: F.concat_ws(" ", F.slice("ws", i, m))))), lambda x: x != "")
    inside = cands.filter("len > 2").select("lang", "a", F.explode(subs).alias("phrase")).groupBy("lang", "phrase").agg(
        F.max("a").alias("most"))
    kept = best.join(inside, ["lang", "phrase"], "left").filter(
        F.col("most").isNull() | (_exact("most") * 100 < _exact("a") * inside_percent))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    # ranked in parts first, so that a language is never one task's rows
    kept = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(128)))
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    for by in (("lang", "part"), ("lang",)):
        kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= top)
    return kept.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
