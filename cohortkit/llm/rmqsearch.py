"""Ranked lexical search with range-maximum tables over posting lists.

The index is cut by documents: every task reads its documents, makes posting lists of a block of them, and answers all queries
for the block, so that no posting is shuffled.  A posting's impact is what one occurrence of the term in a query is worth, but for
the term's weight.  A sparse table over the impacts gives the posting with the largest impact of any part of a list
in two look-ups.

A search starts with the whole block as one interval of documents.  The sum over the query's terms of weight times the largest
impact inside an interval bounds the score of each document in it.  Intervals are taken in order of their bounds; an interval is
split at the document that holds its largest single contribution, which is scored, and both sides get bounds from new range maxima.
An interval of ``leaf`` documents or fewer is scored whole from the postings inside it.  What cannot reach the k-th best score so
far is never opened; scores found in earlier blocks of the task count for later ones.  Bounds equal to the k-th score are opened,
so ties are settled by id exactly.

Scores (64-bit integers) need corpus statistics (documents, terms, document frequencies of the query terms), which a first pass
counts over all documents.  Queries are dealt to blocks of ``item_bytes``; each block of queries is searched against all documents.

Defined cases: NULL or empty texts have no terms (no document of the corpus, no result for the item); repeated document rows are
documents of their own; repeated (item, text) rows are one item, rows with one id and several texts are several items;
NULL document ids rank last among equal scores; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortkit.llm.common import ranges, text_batches, text_or_empty

BLOCK = 8 << 20  # bytes of text of a block of documents
# a term's bytes: ASCII letters and digits, and all bytes of other characters; the rest separates
_TERM = bytes(c if c > 127 or re.match(rb"[0-9a-z]", bytes([c])) else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_LAST = np.iinfo(np.int64).max


def terms(text: str) -> list[bytes]:
    """Maximal runs of term characters, A-Z lower-cased."""
    return text.encode().translate(_TERM).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Block:
    """Posting lists of a block of documents for the terms of a vocabulary, with sparse tables over their impacts.

    tokens: vocabulary numbers of all term occurrences (-1: not in it), text by text; lens: occurrences of each text.
    Documents are numbered so that those with the same most frequent term, and then those of like length, are neighbours, which
    makes intervals alike inside and their bounds tight.
    """

    def __init__(self, tokens: np.ndarray, lens: np.ndarray, vocabulary: int, n_docs: int, n_terms: int):
        n = len(lens)
        own = np.repeat(np.arange(n), lens)
        known = tokens >= 0
        key, tf = np.unique(tokens[known].astype(np.int64) + own[known] * vocabulary, return_counts=True)
        own, term = key // vocabulary, key % vocabulary
        o = np.lexsort((term, -tf, own))
        lead = np.full(n, vocabulary)
        first = np.flatnonzero(np.concatenate([[True], own[o][1:] != own[o][:-1]])) if len(o) else o
        lead[own[o[first]]] = term[o[first]]
        self.order = np.lexsort((lens, lead))  # number in the block -> text
        number = np.empty(n, np.int64)
        number[self.order] = np.arange(n)
        self.size = n
        key = term * n + number[own]
        o = np.argsort(key)
        self.key, tf = key[o], tf[o].astype(np.int64)
        self.doc = self.key % max(n, 1)
        m = 25 + (75 * lens[self.order].astype(np.int64) * n_docs) // n_terms
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[self.doc])
        self.offset = np.searchsorted(self.key, np.arange(vocabulary + 1) * n)
        longest = int(np.diff(self.offset).max(initial=0))
        p = len(self.key)
        best = np.arange(p, dtype=np.int32)
        levels = [best]
        span = 1
        while span * 2 <= longest:
            left, right = best[:p - span], best[span:]
            nxt = best.copy()  # places too near the end for this span are never asked for
            nxt[:p - span] = np.where(self.impact[right] > self.impact[left], right, left)
            best = nxt
            levels.append(best)
            span *= 2
        self.table = np.stack(levels)

    def largest(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and impact of the largest posting of each range [a, b); impact 0 for an empty one."""
        some = b > a
        level = np.frexp(np.maximum(b - a, 1))[1] - 1
        x = self.table[level, np.where(some, a, 0)]
        y = self.table[level, np.where(some, b - (1 << level), 0)]
        vx, vy = self.impact[x], self.impact[y]
        return np.where(vy > vx, y, x), np.where(some, np.maximum(vx, vy), 0)

    def search(self, term: np.ndarray, w: np.ndarray, best: Best, ids: np.ndarray, leaf: int, width: int) -> None:
        """Improve ``best`` by this block's documents for a query of distinct ``term`` numbers of weights ``w``."""
        a, b = self.offset[term][None], self.offset[term + 1][None]
        lo, hi = np.zeros(1, np.int64), np.full(1, self.size)
        at, top = self.largest(a, b)
        bound = (top * w).sum(axis=1)
        while True:
            open_ = bound >= best.least
            if not open_.any():
                return
            if not open_.all():
                a, b, lo, hi, at, top, bound = (x[open_] for x in (a, b, lo, hi, at, top, bound))
            if len(bound) > width:
                rank = np.argpartition(-bound, width)
                take, rest = rank[:width], rank[width:]
            else:
                take, rest = slice(None), slice(0, 0)
            ta, tb, tlo, thi, tat, ttop = (x[take] for x in (a, b, lo, hi, at, top))
            small = thi - tlo <= leaf
            if small.any():
                n = (tb[small] - ta[small]).ravel()
                post = ranges(ta[small].ravel(), n)
                d, k = np.unique(self.doc[post], return_inverse=True)
                worth = np.zeros(len(d), np.int64)
                np.add.at(worth, k, self.impact[post] * np.repeat(np.tile(w, small.sum()), n))
                best.offer(worth, ids[:, self.order[d]])
            big = ~small
            ta, tb, tlo, thi, tat, ttop = (x[big] for x in (ta, tb, tlo, thi, tat, ttop))
            if len(ta):
                lead = (ttop * w).argmax(axis=1)
                d = self.doc[tat[np.arange(len(lead)), lead]]
                key = term[None] * self.size + d[:, None]
                cut = np.clip(np.searchsorted(self.key, key), ta, tb)
                has = (cut < tb) & (self.key[np.minimum(cut, len(self.key) - 1)] == key)
                worth = (np.where(has, self.impact[np.minimum(cut, len(self.key) - 1)], 0) * w).sum(axis=1)
                best.offer(worth, ids[:, self.order[d]])
                na, nb = np.concatenate([ta, cut + has]), np.concatenate([cut, tb])
                nlo, nhi = np.concatenate([tlo, d + 1]), np.concatenate([d, thi])
                nat, ntop = self.largest(na, nb)
                new = (na, nb, nlo, nhi, nat, ntop, (ntop * w).sum(axis=1))
                a, b, lo, hi, at, top, bound = (np.concatenate([x[rest], y]) for x, y in zip((a, b, lo, hi, at, top, bound), new))
            else:
                a, b, lo, hi, at, top, bound = (x[rest] for x in (a, b, lo, hi, at, top, bound))


class Best:
    """The k best documents of a query so far: higher scores first, then smaller ids, NULL ids last."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.score = np.zeros(0, np.int64)
        self.ids = np.zeros((2, 0), np.int64)  # is NULL, id

    def offer(self, score: np.ndarray, ids: np.ndarray) -> None:
        good = score >= self.least
        if not good.any():
            return
        score, ids = np.concatenate([self.score, score[good]]), np.concatenate([self.ids, ids[:, good]], axis=1)
        o = np.lexsort((ids[1], ids[0], -score))[:self.k]
        self.score, self.ids = score[o], ids[:, o]
        if len(o) == self.k:
            self.least = int(self.score[-1])


def _tokens(texts: list[str], vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Vocabulary numbers (-1: none) of all term occurrences, and each text's number of occurrences."""
    lens, parts = np.zeros(len(texts), np.int64), []
    for i, t in enumerate(texts):
        words = terms(t)
        lens[i] = len(words)
        parts.append(np.fromiter(map(vocabulary.get, words, repeat(-1)), np.int32, len(words)))
    return np.concatenate(parts) if parts else np.zeros(0, np.int32), lens


def statistics(texts: DataFrame, vocabulary: dict[bytes, int]) -> tuple[int, int, np.ndarray]:
    """Documents with a term, term occurrences, and the vocabulary's document frequencies, over all rows of (text)."""
    spark = texts.sparkSession
    shared, v = spark.sparkContext.broadcast(vocabulary), len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(v + 2, np.int64)
        for b in text_batches(batches, "text", BLOCK):
            tokens, lens = _tokens(b.column(0).to_pylist(), shared.value)
            own = np.repeat(np.arange(len(lens)), lens)[tokens >= 0]
            pairs = np.unique(own * v + tokens[tokens >= 0])
            df[:v] += np.bincount(pairs % v, minlength=v)
            df[v] += (lens > 0).sum()
            df[v + 1] += lens.sum()
        t = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(df[t])], ["t", "df"])

    rows = texts.mapInArrow(run, "t long, df long").groupBy("t").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(v + 2, np.int64)  # one row a term of this block of queries
    for r in rows:
        df[r["t"]] = r["df"]
    return int(df[v]), int(df[v + 1]), df[:v]


def _search_block(docs: DataFrame, items: list, item_type: T.DataType, k: int, leaf: int, width: int) -> DataFrame:
    """(item, id, score): each task's k best documents of each (item id, text) of ``items``."""
    counts = [Counter(terms(r["text"])) for r in items]
    vocabulary = {t: i for i, t in enumerate(sorted({t for c in counts for t in c}))}
    n_docs, n_terms, df = statistics(docs.select("text"), vocabulary) if vocabulary else (0, 0, np.zeros(0))
    queries = []
    for no, c in enumerate(counts):
        found = [(vocabulary[t], times * weight(n_docs, int(df[vocabulary[t]]))) for t, times in c.items() if df[vocabulary[t]]]
        if found:
            queries.append((no, *map(np.array, zip(*sorted(found)))))
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, queries = shared.value
        best = [Best(k) for _ in queries]
        for b in text_batches(batches, "text", BLOCK) if queries else ():
            tokens, lens = _tokens(b.column(1).to_pylist(), vocabulary)
            ids = np.stack([np.asarray(b.column(0).is_null()).astype(np.int64), np.asarray(b.column(0).fill_null(_LAST))])
            if (tokens >= 0).any():
                block = Block(tokens, lens, len(vocabulary), n_docs, n_terms)
                for (_, t, w), kept in zip(queries, best):
                    block.search(t, w, kept, ids, leaf, width)
        for (no, *_), x in zip(queries, best):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(x.score), no)), pa.array(x.ids[1], mask=x.ids[0] > 0), pa.array(x.score)],
                ["no", "id", "score"])

    found = docs.mapInArrow(run, "no long, id long, score long")
    order = (F.desc("score"), F.asc_nulls_last("id"))
    # a task's ten are dealt to parts first, so that the number of tasks is never one window's size
    found = found.withColumn("part", F.spark_partition_id() % 64)
    for by in (("no", "part"), ("no",)):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)
    names = T.StructType([T.StructField("no", T.LongType()), T.StructField("item", item_type)])
    of = docs.sparkSession.createDataFrame([(i, r["item"]) for i, r in enumerate(items)], names)
    return found.join(F.broadcast(of), "no").select("item", "rank", "id", "score")  # of: this block of queries


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text", item_bytes: int = 1 << 20, leaf: int = 64,
           width: int = 256) -> DataFrame:
    """(item, rank, id, score): the k best documents of each item; k per item if so many score above 0.

    item_bytes: size of a block of queries (texts, and 64 bytes for each), which its tasks get as a whole;
    leaf: documents that are scored together; width: intervals that are opened at a time.
    """
    d = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(F.col(text_col)).alias("text"))
    q = items.select(F.col(item_col).alias("item"), text_or_empty(F.col(item_text)).alias("text")).distinct()
    total = q.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, math.ceil(total / item_bytes))
    part = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    out = None
    for i in range(blocks):
        found = _search_block(d, q.filter(part == i).collect(), q.schema["item"].dataType, k, leaf, width)
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
