import hashlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortkit.llm import coverdedup
from cohortkit.llm.oracle_sql import ORACLE


def _brute(texts, length):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i:i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i:i + length])] > 1:
                gone[i:i + length] = [True] * length
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def _key(rows):
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in rows)


@pytest.mark.parametrize("period", range(1, 32))
def test_difference_cover(period):
    d = coverdedup.difference_cover(period)
    assert {(x - y) % period for x in d for y in d} == set(range(period))
    assert period < 2 or len(d) * (len(d) - 1) + 1 >= period
    assert period != 21 or len(d) == 5


@pytest.mark.parametrize("length,period", [(35, 21), (12, 5), (8, 8), (6, 1)])
def test_removal_equals_brute_force(small_docs, small_rows, length, period):
    want = [(r[0], *x) for r, x in zip(small_rows, _brute([r[1] for r in small_rows], length))]
    got = coverdedup.digests(small_docs, length=length, period=period).collect()
    assert _key(map(tuple, got)) == _key(want)
    assert any(x[2] for x in want) and any(0 < x[2] < x[1] for x in want)


@pytest.mark.parametrize("batch", [1 << 10, 1 << 22])
def test_edited_copies_and_self_overlaps(spark, monkeypatch, batch):
    """Copies with random edits, cut at random places; runs of one word; few and many documents a batch."""
    monkeypatch.setattr(coverdedup, "BATCH", batch)
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 60, 900)]
    texts = ["x " * 200, "x " * 36, "x " * 35, "x y " * 40, " ".join(["lone", *["x"] * 34])]
    for _ in range(80):
        t = list(base)
        for k in rng.integers(0, 900, rng.integers(0, 30)):
            t[k] = f"e{rng.integers(0, 5)}"
        lo = rng.integers(0, 700)
        texts.append("\t".join(t[lo:lo + rng.integers(20, 300)]))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    got = sorted(map(tuple, coverdedup.digests(d).collect()))
    assert got == [(i, *x) for i, x in enumerate(_brute(texts, 35))]


def test_long_text_clashing_columns_and_empty_table(spark, no_docs):
    """A text beyond a batch, which repeats inside itself; columns named as the internal ones."""
    rng = np.random.default_rng(8)
    half = " ".join(f"{x:x}" for x in rng.integers(0, 1 << 40, 250_000))
    rows = [(1, half + "\n" + half), (2, "own words of a short text"), (2, None), (None, "x " * 99), (None, "x " * 99)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("id", "th", "h", "c", "state", "a", "b", "spans", "places", "n_words", "kept"):
        d = d.withColumn(c, F.lit(7))
    got = _key(map(tuple, coverdedup.digests(d).collect()))
    assert got == _key((r[0], *x) for r, x in zip(rows, _brute([r[1] for r in rows], 35)))
    assert coverdedup.digests(no_docs).count() == 0


def test_sql_says_the_same(spark, small_docs, small_rows):
    con = duckdb.connect()
    import pandas as pd
    documents = pd.DataFrame({"doc_id": range(len(small_rows)), "text": [r[1] for r in small_rows]})  # noqa: F841
    want = con.sql(ORACLE["op12_cover_dedup"]).fetchall()
    d = spark.createDataFrame([(i, r[1]) for i, r in enumerate(small_rows)], "doc_id long, text string")
    assert sorted(map(tuple, coverdedup.digests(d).collect())) == sorted(want)
