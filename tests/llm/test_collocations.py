import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortkit.llm import collocations
from cohortkit.llm.oracle_sql import ORACLE

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _counts(docs):
    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for m in range(1, 5):
                f[lang].update(tuple(ws[i:i + m]) for i in range(len(ws) - m + 1))
    return f, n


def _brute(docs, least, top, percent=80):
    out = []
    f, n = _counts(docs)
    for lang, g in f.items():
        cands = {p: a for p, a in g.items() if len(p) > 1 and a >= least}
        inside = set()
        for p, a in cands.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    if 100 * a >= percent * cands[p[i:i + m]]:
                        inside.add(p[i:i + m])
        rows = []
        for p, a in cands.items():
            if p not in inside:
                score, k = min((2000000 * a // (g[p[:k]] + g[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), a, g[p[:k]], g[p[k:]]))
        out += [(lang, r + 1, x[2].decode(), x[3], x[4], x[5], n[lang], -x[0]) for r, x in enumerate(sorted(rows)[:top])]
    return sorted(out)


@pytest.mark.parametrize("spacing,bits,batch", [(32, 27, 8 << 20), (1, 8, 1 << 12), (3, 14, 1 << 30)])
def test_phrases_equal_brute_force(spark, monkeypatch, small_docs, small_rows, spacing, bits, batch):
    """The parse, the batches and a table of bits that is nearly full change nothing."""
    monkeypatch.setattr(collocations, "BATCH", batch)
    got = collocations.mine(small_docs, least=5, top=300, spacing=spacing, table_bits=bits)
    assert sorted(map(tuple, got.collect())) == _brute([(r[1], r[2]) for r in small_rows], 5, 300)


def test_overlaps_copies_and_long_text(spark):
    rng = np.random.default_rng(4)
    words = ["a", "b", "ab", "the", "é", "x-y", "10%"]
    body = " ".join(words[i] for i in rng.integers(0, 7, 3000))
    docs = [(body, "q")] * 5 + [("A a\ta  a a,a b.a b;" * 50, None), ("a " * 1_500_000, "q"), (None, "q"), ("", None), (" .. \n", "z"),
            ("one", "und"), ("one two three", "z"),
            (f"{'u' * 70} {'v' * 300} end. " * 4 + f"{'u' * 71} {'v' * 300} end", "q")]
    d = spark.createDataFrame(docs, "text string, lang string")
    for c in ("chunk", "a", "l", "n", "rank", "phrase", "ws", "part"):
        d = d.withColumn(c, F.lit("x"))
    got = collocations.mine(d, least=3, top=50)
    assert sorted(map(tuple, got.collect())) == _brute(docs, 3, 50)


def test_the_parse_is_prefix_free_and_whole():
    rng = np.random.default_rng(5)
    texts = [[f"{x}".encode() for x in rng.integers(0, 30, n)] for n in (0, 1, 2, 3, 4, 200, 0, 500)]
    words = [w for t in texts for w in t]
    lens = np.array([len(t) for t in texts])
    starts = np.cumsum(lens) - lens
    at = set(collocations.chunk_starts(words, starts, lens, 5).tolist())
    assert {int(s) for s, n in zip(starts, lens) if n} <= at and len(at) > 80
    seen = {}
    for s, n in zip(starts, lens):
        for i in range(s + 1, s + n - 2):  # whether three tokens are a trigger depends on them alone
            assert seen.setdefault(tuple(words[i:i + 3]), i in at) == (i in at)
        assert not at & {int(x) for x in range(max(s + 1, s + n - 2), s + n)}


def test_large_counts_are_exact(spark, monkeypatch):
    """Products past 64 bits: counts of 9 * 10^17."""
    big = 9 * 10 ** 17
    rows = [("q", "", 4 * big), ("q", "a", big), ("q", "b", big + 7), ("q", "a b", big - 1)]
    monkeypatch.setattr(collocations, "frequent_phrases", lambda *a: spark.createDataFrame(rows, collocations.COUNTS))
    got = collocations.mine(spark.createDataFrame([("x", "q")], "text string, lang string")).collect()
    assert [tuple(r) for r in got] == [("q", 1, "a b", big - 1, big, big + 7, 4 * big, 2000000 * (big - 1) // (2 * big + 7))]


def test_empty_table(no_docs):
    assert collocations.mine(no_docs).count() == 0


def test_sql_says_the_same(spark):
    d = "/root/testdata/sf0.001"
    documents = pd.read_parquet(f"{d}/documents.parquet")  # noqa: F841
    want = duckdb.connect().sql(ORACLE["op13_collocations"]).fetchall()
    got = collocations.mine(spark.read.parquet(f"{d}/documents.parquet"))
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 5
