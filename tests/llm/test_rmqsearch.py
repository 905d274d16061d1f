import math
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortkit.llm import rmqsearch
from cohortkit.llm.oracle_sql import ORACLE

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _terms(t):
    return TERM.findall((t or "").translate(LOWER))


def _brute(docs, items, k):
    """[(item, rank, id, score)] of (id, text) rows."""
    ts = [(i, _terms(t)) for i, t in docs]
    n_docs, n_terms = sum(1 for _, t in ts if t), sum(len(t) for _, t in ts)
    df = Counter(t for _, x in ts for t in set(x))
    out = []
    for item, text in sorted({(i, t or "") for i, t in items}):
        found = []
        for i, x in ts:
            tf, score = Counter(x), 0
            m = 25 + (75 * len(x) * n_docs) // max(n_terms, 1)
            for t in _terms(text):
                if tf[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def _got(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("leaf,width,block,item_bytes", [(64, 256, 8 << 20, 1 << 20), (1, 3, 1 << 14, 2000), (7, 1, 1 << 30, 1 << 20)])
def test_ranks_equal_brute_force(spark, monkeypatch, small_docs, small_rows, leaf, width, block, item_bytes):
    monkeypatch.setattr(rmqsearch, "BLOCK", block)
    items = [(r[0], r[1][:200]) for r in small_rows[:12] if r[1]] + [
        (90, None), (91, ""), (92, "token TOKEN token a"), (92, "another text of item 92, the of de"), (93, "İstanbul ½ ünknown"), (0, small_rows[0][1][:200])]
    q = spark.createDataFrame(items, "item_id long, text string")
    got = _got(rmqsearch.search(small_docs, q, leaf=leaf, width=width, item_bytes=item_bytes))
    assert got == _brute([r[:2] for r in small_rows], items, 10)


def test_ties_and_copies(spark):
    """Many equal texts: ties at the tenth place go to the smaller id, NULL ids last, repeated rows each count."""
    rng = np.random.default_rng(1)
    texts = [" ".join(f"t{x}" for x in rng.integers(0, 25, 12)) for _ in range(20)]
    docs = [(int(i), texts[i % 20]) for i in rng.permutation(600)] + [(None, texts[3])] * 3 + [(5, texts[5])] * 4
    items = [(i, texts[i]) for i in range(20)] + [(50, "t1 t2 t3"), (51, "t1 " * 70)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(9)
    q = spark.createDataFrame(items, "item_id long, text string")
    for k in (1, 10, 200):
        assert _got(rmqsearch.search(d, q, k=k, leaf=4, width=8)) == _brute(docs, items, k)


def test_range_maxima(spark):
    rng = np.random.default_rng(2)
    lens = rng.integers(0, 60, 300)
    tokens = rng.integers(-1, 9, lens.sum()).astype(np.int32)
    b = rmqsearch.Block(tokens, lens, 9, 300, int(lens.sum()))
    for t in range(9):
        lo, hi = b.offset[t], b.offset[t + 1]
        x, y = np.sort(rng.integers(lo, hi + 1, (2, 200)), axis=0)
        at, top = b.largest(x, y)
        for i, j, p, v in zip(x, y, at, top):
            assert v == b.impact[i:j].max(initial=0) and (i == j or (i <= p < j and b.impact[p] == v))


def test_long_text_clashing_columns_and_empty_tables(spark, no_docs, small_rows):
    docs = [(1, "alpha beta " * 900_000), (2, "alpha"), (3, None), (4, "beta ALPHA")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    for c in ("id", "item", "item_id", "rank", "score", "no", "part"):
        d = d.withColumn(c, F.lit("x"))
    items = [("a", "Alpha"), ("b", "beta beta")]
    q = spark.createDataFrame(items, "item_id string, text string").withColumn("doc_id", F.lit(0)).withColumn("item", F.lit(1))
    assert _got(rmqsearch.search(d, q)) == _brute(docs, items, 10)
    assert rmqsearch.search(no_docs, q).count() == 0
    assert rmqsearch.search(d, q.limit(0)).count() == 0


def test_sql_says_the_same(spark):
    d = "/root/testdata/sf0.001"
    documents, benchmark = pd.read_parquet(f"{d}/documents.parquet"), pd.read_parquet(f"{d}/benchmark.parquet")  # noqa: F841
    want = duckdb.connect().sql(ORACLE["op11_lexical_search"]).fetchall()
    got = rmqsearch.search(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet"))
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and _got(got) == sorted(want, key=str) and len(want) == 400
