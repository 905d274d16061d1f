import zlib

import numpy as np
from pyspark.sql import functions as F

from cohortkit.llm import langid, quality
from tests.llm.conftest import SMALL


def test_forward_backward_equals_the_plain_recursion():
    rng = np.random.default_rng(0)
    counts = np.array([130, 1, 64, 5])
    e, tr = rng.normal(size=(200, 3)), rng.normal(size=(3, 3))
    post, pair = langid.posteriors(e.T.copy(), counts, tr, pairs=True)
    s = 0
    for k in counts:
        x = e[s:s + k]
        al, be = np.zeros((k, 3)), np.zeros((k, 3))
        al[0] = np.log(np.exp(tr).sum(0)) + x[0]
        for i in range(1, k):
            al[i] = np.log(np.exp(al[i - 1][:, None] + tr).sum(0)) + x[i]
        for i in range(k - 2, -1, -1):
            be[i] = np.log(np.exp(tr + x[i + 1] + be[i + 1]).sum(1))
        q = np.exp(al + be - (al + be).max(1, keepdims=True))
        assert np.allclose((q / q.sum(1, keepdims=True)).T, post[:, s:s + k], atol=1e-9)
        s += k
    assert np.isclose(pair.sum(), counts.sum() - len(counts))


def test_language_id(small_docs, small_rows, no_docs):
    got = langid.identify(small_docs).collect()
    assert len(got) == len(small_rows)
    lang = {r[0]: (r[1], r[2]) for r in small_rows}
    seen = hits = 0
    for r in got:
        i = r["doc_id"]
        assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0)
        t, label = lang[i]
        assert 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in t or ""))
        if r["held_out"] and i <= 199:
            seen, hits = seen + 1, hits + (r["lang_pred"] == label)
    assert hits >= 0.95 * seen > 0
    assert langid.identify(no_docs).count() == 0
    blind = langid.identify(small_docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in blind.collect()} == {"und"}


def test_code_switched_words_are_told_apart(small_rows):
    docs = [(r[1], r[2]) for r in small_rows if r[0] is not None and r[0] < 200 and r[2]]
    m = langid.fit([t for t, _ in docs], [k for _, k in docs], 25)
    en, de = (max((t for t, k in docs if k == x), key=len) for x in ("en", "de"))
    a, b = langid.words_of(en)[:60], langid.words_of(de)[:60]
    post, _ = langid.posteriors(m.emissions(a + b), np.array([120]), m.transitions)
    best = [m.labels[k] for k in post.argmax(axis=0)]
    assert best[:60].count("en") >= 50 and best[60:].count("de") >= 50


def test_quality(spark, small_docs, small_rows, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    y = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [(got[i]["predicted"], q) for i, q in y.items() if got[i]["held_out"]]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert sum(p == q for p, q in held) >= 0.95 * len(held) > 0
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    odd = quality.classify(small_docs, labels)
    assert odd.count() == len(small_rows) and odd.filter("score is null").isEmpty()
    assert quality.classify(no_docs, labels).count() == 0
    m = quality.train(small_docs, labels.limit(0))
    assert quality.keep_good(small_docs, m).columns == small_docs.columns


def test_passages_do_not_depend_on_the_batch():
    texts = ["", "a b", " ".join(f"w{i}" for i in range(130)), "x  y\n" * 40, " \n "]
    x, c = quality.passages([t.encode() for t in texts])
    assert c.tolist() == [1, 1, 3, 2, 1]
    at = np.cumsum(c) - c
    for i, t in enumerate(texts):
        y, k = quality.passages([t.encode()])
        assert np.allclose(y, x[at[i]:at[i] + c[i]], atol=1e-6)


def test_samples_hold_long_texts_and_rare_classes(spark):
    rows = [(i, f"der Hund und die Katze gehen heute nach Hause {i} " * 3, "de") for i in range(30)]
    rows += [(100 + i, f"the dog and the cat walk home together today {i} " * 40, "en") for i in range(30)]  # all long
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = langid.training_sample(d, "lang", "text", 300, 400).collect()
    assert len(sample) == 60 and max(len(r["text"]) for r in sample) == 400
    assert len({r["text"][:20] for r in sample if r["label"] == "en"}) > 5  # from different places
    m = langid.train(d, max_chars=400)
    assert m.labels == ["de", "en"]
    assert {(r["lang"], r["lang_pred"]) for r in langid.predict(d, m, ["doc_id", "lang"]).collect()} == {("de", "de"), ("en", "en")}

    assert quality.class_shares({0: 3, 1: 1000}, 103) == {0: 1.0, 1: 0.1} and quality.class_shares({0: 1, 1: 2}, 3) == {0: 1.0, 1: 1.0}
    good, bad = "a calm walk by the river brings quiet thoughts to us all. ", "$$$ 0x1 %% 99 ## 17 @@ ?? "
    rows = [(i, good * (3 + i % 5), 1) for i in range(2000)] + [(5000 + i, bad * 3000, 0) for i in range(3)]  # rare and long
    d = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    m = quality.train(d.select("doc_id", "text"), d.select("doc_id", "quality"), max_docs=100)
    s = {r["doc_id"]: r["score"] for r in quality.score(d, m, ["doc_id"]).collect()}
    assert max(s[5000 + i] for i in range(3)) < 0.5 < 0.9 < min(s[i] for i in range(2000))
