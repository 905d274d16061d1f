import hashlib
import re
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from cohortkit.llm import pieces, secrets

ASSIGN = re.compile(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")


def _base(text):
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return sorted(out)


def test_base_spans_equal_python(small_docs, small_rows, no_docs):
    got = Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"])
                  for r in secrets.scan_digests(small_docs.withColumn("id", F.lit(1))).collect())
    want = Counter()
    for i, t, *_ in small_rows:
        b = _base(t or "")
        line = ",".join(f"{k}:{s}:{e}" for s, _, k, e in b)
        want[(i, *[sum(x[2] == k for x in b) for k in ("assign", "access", "hex")], hashlib.sha256(line.encode()).hexdigest())] += 1
    assert got == want
    assert secrets.scan_digests(no_docs).count() == 0


def test_ownership_separates_examples_from_live_values(spark):
    rows = [(i, f"see token = 'a1b2c3d4e5f6' and more {i}", None, f"src{i % 5}", 0) for i in range(20)]
    rows += [(100, "é password=Zx81kQ92mmW7 end", None, "src1", 27), (101, "nothing here", None, "src1", 12)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    r = {x["doc_id"]: x["spans"] for x in secrets.scan_digests(d).collect()}
    assert r[100] == "assign:2:23,live:11:23" and "example" in r[3] and "live" not in r[3] and r[101] == ""
    out = {x["doc_id"]: x for x in secrets.redact(d).collect()}
    assert out[100]["text"] == "é password=[SECRET] end" and out[100]["n_chars"] == 23
    assert out[3]["text"] == rows[3][1] and out[101]["text"] == "nothing here" and len(out) == len(rows)


def test_secrets_of_copied_documents_are_redacted(spark):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]

    def text(value, start, changed=()):
        w = [words[(start + 7 * i * i + i) % 400] for i in range(150)]
        for c in changed:
            w[c] = "other"
        return " ".join(w[:75]) + f" password = {value} " + " ".join(w[75:])

    rows = [("A1b2C3d4E5f6", text("A1b2C3d4E5f6", 0), s) for s in ("src0", "src1", None)]  # exact copies, three owners
    rows += [("Q7r8S9t0U1v2", text("Q7r8S9t0U1v2", 50), "src2") for _ in range(4)]  # exact copies, one owner
    rows += [("M3n4O5p6R7s8", text("M3n4O5p6R7s8", 90, (k, 40 + k, 140 - k)), f"src{k % 3}") for k in range(6)]
    rows += [("E9x8A7m6P5l4", " ".join(f"{chr(97 + k)}{w}" for w in words[:99]) + " token = E9x8A7m6P5l4", f"src{k % 3}")
             for k in range(6)]  # an example: different texts and owners
    d = spark.createDataFrame([(i, t, None, s, len(t)) for i, (_, t, s) in enumerate(rows)],
                              "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: r["text"] for r in secrets.redact(d).collect()}
    assert len(out) == len(rows)
    for i, (v, t, _) in enumerate(rows):
        assert out[i] == (t if v.startswith("E9") else t.replace(v, "[SECRET]"))


def test_pipeline_stages(spark, tmp_path, small_docs):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, before = docs.columns, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, d).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == columns
        if name == "quality":
            y = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
            kept = {r["doc_id"] for r in after.select("doc_id").collect()}
            assert sum(i in kept for i, q in y.items() if q == 1) >= 0.97 * sum(q == 1 for q in y.values())
            assert sum(i in kept for i, q in y.items() if q == 0) <= 0.05 * sum(q == 0 for q in y.values()) + 1
        elif name == "near_duplicates":
            assert after.select("text").distinct().count() == after.count() < before.count()
        elif name == "secrets":
            assert after.count() == before.count() and not after.filter("text like '%[SECRET]%'").isEmpty()
            assert secrets.scan(after).filter("kind = 'live'").isEmpty()
        elif name == "mixing":
            assert set(r[0] for r in after.groupBy("doc_id").count().select("count").distinct().collect()) <= {1, 2}
        else:
            sp = pieces.processor(pieces.default_model())
            text = {r["doc_id"]: r["text"] for r in before.collect()}
            assert after.count() == before.count()
            assert all(r["ids"] == sp.encode(text[r["doc_id"]]) for r in after.limit(200).collect())
        before = after
    odd = small_docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, odd, "/root/testdata/sf0.001").write.parquet(f"{tmp_path}/odd-{name}")
        odd = spark.read.parquet(f"{tmp_path}/odd-{name}")


def test_whole_run_equals_a_plain_pipeline(spark):
    import duckdb
    import pandas as pd

    from cohortkit.llm import quality, simhash
    from cohortkit.llm.oracle_sql import MIXING

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = {r["doc_id"]: r.asDict() for r in docs.collect()}
    labels = spark.read.parquet(f"{d}/labels.parquet").filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    m = quality.train(docs, labels)
    kept = [i for i in sorted(rows) if quality.score_texts(m, [rows[i]["text"]])[0] >= 0.7]
    fp = {i: simhash.text_fingerprint(rows[i]["text"] or "", 4) for i in kept}
    root = {i: i for i in kept}
    near = 0
    for a in kept:
        for b in kept:
            if a < b and (fp[a] ^ fp[b]).bit_count() <= 4:
                near += fp[a] != fp[b]
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    kept = [i for i in kept if root[i] == i]
    assert near > 0
    left = docs.filter(F.col("doc_id").isin(kept))
    live = {}
    for r in secrets.scan(left, by_content=True).filter("kind = 'live'").collect():
        live.setdefault(r["id"], set()).update(range(r["start"], r["end"]))
    text = {}
    for i in kept:
        hidden = live.get(i, set())
        text[i] = "".join("[SECRET]" if k in hidden and k - 1 not in hidden else "" if k in hidden else c
                          for k, c in enumerate(rows[i]["text"] or ""))
    documents = pd.DataFrame([(i, text[i], rows[i]["source"]) for i in kept], columns=["doc_id", "text", "source"])  # noqa: F841
    mixed = duckdb.sql(MIXING).fetchall()
    copies = Counter({i: int(taken // size) for i, size, _, _, taken in mixed if size})
    sp = pieces.processor(pieces.default_model())
    want = {i: (rows[i]["source"], sp.encode(text[i])) for i in kept}
    got = Counter()
    for r in corpus_pipeline.run(spark, d).collect():
        assert (r["source"], r["ids"]) == want[r["doc_id"]] and r["n_tokens"] == len(r["ids"])
        got[r["doc_id"]] += 1
    assert got == +copies and max(got.values()) == 2


def test_sql_and_query_agree_on_null_sources(spark):
    """A NULL source is an owner like any other."""
    import duckdb
    import pandas as pd

    from cohortkit.llm.oracle_sql import ORACLE

    value = ["q9w8e7r6t5y4u3i2o1p0", "Z1x2C3v4B5n6M7a8S9d0", "aA1bB2cC3dD4eE5fF6gG"]
    rows = [(1, f"secret={value[0]} here", None), (2, f"other text token={value[0]}", "web"), (3, f"key {value[1]}", None),
            (4, f"a key {value[1]} again", None), (5, f"x token={value[2]}", "web"), (6, f"y token={value[2]}", "code")]
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "source"])  # noqa: F841
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    cols = ["doc_id", "n_live", "n_example", "spans"]
    sql = duckdb.connect().sql(ORACLE["op8_secrets"]).df()[cols]
    got = secrets.scan_digests(d).select(*cols).toPandas()
    want = {1: (0, 1), 2: (0, 1), 3: (1, 0), 4: (1, 0), 5: (0, 1), 6: (0, 1)}
    for frame in (sql, got):
        assert {r.doc_id: (r.n_live, r.n_example) for r in frame.itertuples()} == want
    assert sorted(map(tuple, got.drop_duplicates().values)) == sorted(map(tuple, sql.drop_duplicates().values))
