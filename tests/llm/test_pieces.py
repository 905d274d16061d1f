import hashlib
import random

from cohortkit.llm import pieces


def _expected(sp, t):
    ids = sp.encode(t or "")
    return (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(sp.decode(ids).encode()).hexdigest())


def test_round_trip_equals_the_library(small_docs, small_rows):
    sp = pieces.processor(pieces.default_model())
    got = sorted(tuple(r) for r in pieces.round_trip(small_docs.filter("doc_id is not null")).collect())
    want = sorted((r[0], *_expected(sp, r[1])) for r in small_rows if r[0] is not None)
    assert got == want


def test_chunk_table_on_random_strings():
    sp = pieces.processor(pieces.default_model())
    assert pieces.marks_lead(sp)
    rng = random.Random(1)
    texts = ["".join(rng.choice(" ▁ab\n.é😀\x00<0>") for _ in range(rng.randrange(30))) for _ in range(3000)]
    table = pieces.ChunkTable(sp, max_chunks=50)  # starts afresh all the time
    for s in range(0, len(texts), 100):
        flat, n = table.ids(texts[s:s + 100])
        at = 0
        for t, k in zip(texts[s:s + 100], n):
            assert flat[at:at + k].tolist() == sp.encode(t), t
            at += k


def test_empty_and_clashing_columns(no_docs, small_docs):
    assert pieces.round_trip(no_docs).count() == 0
    d = small_docs.withColumn("ids", small_docs["text"]).withColumn("n_tokens", small_docs["text"])
    assert pieces.round_trip(d).count() == small_docs.count()
