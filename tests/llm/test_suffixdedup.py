import hashlib
from collections import Counter

import numpy as np
import pytest

from cohortkit.llm import suffixdedup


def _brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), int(gone.sum()), len(edge), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("most", [4000, 3])
def test_removal_equals_brute_force(small_docs, small_rows, most):
    """``most`` = 3 divides almost every group down to single windows."""
    want = sorted((r[0] if r[0] is not None else -1, *x) for r, x in zip(small_rows, _brute([r[1] for r in small_rows], 200)))
    got = suffixdedup.digests(small_docs, max_segments=most, block_bytes=1 << 14).collect()
    assert sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in got) == want


def test_near_copies(spark):
    rng = np.random.default_rng(5)
    base = "".join(rng.choice(list("abcdefgh "), 3000))
    texts = []
    for i in range(60):
        t = list(base)
        for k in rng.integers(0, 3000, rng.integers(1, 25)):
            t[k] = "Z"
        texts.append("".join(t)[rng.integers(0, 400):])
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for most in (5, 4000):
        got = sorted(tuple(r) for r in suffixdedup.digests(d, max_segments=most).collect())
        assert got == [(i, *x) for i, x in enumerate(_brute(texts, 200))]


def test_suffix_array_sorts_and_finds_repeats(monkeypatch):
    rng = np.random.default_rng(0)
    for trial in range(80):
        monkeypatch.setattr(suffixdedup, "UNIT", 5 if trial % 2 else 10)
        k, al = rng.integers(1, 5), rng.integers(1, 4)
        segs = [bytes(rng.integers(97, 97 + al, rng.integers(1, 60)).astype(np.uint8)) for _ in range(k)]
        t = np.frombuffer(b"\0".join(segs) + b"\0", np.uint8)
        sa = suffixdedup.suffix_array(t, suffixdedup.unit_ranks(t), 64)
        assert sorted(sa.tolist()) == list(range(len(t)))
        order = [bytes(t[i:]).split(b"\0")[0] for i in sa]
        assert order == sorted(order)
        got = suffixdedup.repeats(segs, np.arange(k) * 1000, np.zeros(k, bool), 10)
        c = Counter(s[i:i + 10] for s in segs for i in range(len(s) - 9))
        cover = {(q, j) for q, s in enumerate(segs) for i in range(len(s) - 9) if c[s[i:i + 10]] > 1 for j in range(i, i + 10)}
        assert {(q, j) for q, a, b in got for j in range(a, b)} == cover


def test_empty(no_docs):
    assert suffixdedup.digests(no_docs).count() == 0


def test_segments_that_go_on_over_arrow_batches(spark, small_docs, small_rows):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = suffixdedup.digests(small_docs).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = sorted((r[0] if r[0] is not None else -1, *x) for r, x in zip(small_rows, _brute([r[1] for r in small_rows], 200)))
    assert sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in got) == want


def test_division_keeps_only_parts_that_share_their_core(spark, monkeypatch):
    """Many segments around one common passage, all in different texts but two: the others leave after one division."""
    rng = np.random.default_rng(8)
    word = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    passage = word(120)
    texts = [word(170) + passage + word(170) for _ in range(60)]
    texts += [texts[3][100:380] + word(90), word(30) + texts[5][140:345]]
    sizes = {}
    plain = suffixdedup.materialize

    def counted(df, name=None, frees=()):
        out = plain(df, name, frees)
        sizes.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(suffixdedup, "materialize", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(suffixdedup.digests(docs, max_segments=5, block_bytes=1 << 14).collect())
    assert [tuple(r[1:]) for r in got] == _brute(texts, 200)
    assert sum(r[2] > 0 for r in got) == 4
    # segments of the passage, cut into 8 ranges: only those of the four texts stay, and no group needs another division
    assert sizes["sa-big"][0] > 30 and sizes["sa-parts"] == [min(sizes["sa-parts"][0], 30)]
