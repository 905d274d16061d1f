"""Document quality by attention-based multiple-instance learning.

A text is a bag of passages (64 words each).  Each passage is described by the shares of
byte kinds and of their successions, of hashed words, and by word-length and repetition figures, and encoded
by a dense layer.  A gated attention network (tanh branch times sigmoid branch) weighs the passages; the weighted mean of
their encodings goes through a logistic unit.  Only documents have labels, so attention learns which
passages decide.  Encoder, attention and output are fitted together by Adam.

The classifier is fitted on a bounded sample: about ``max_docs`` labelled texts of at most ``max_chars``
characters.  Scoring reads every passage of every text, a batch of about 1 MB at a time (one text at least, so memory grows with the longest).

Defined cases: NULL and empty texts are one passage without words; a text's repeated rows are independent;
labels that are NULL teach nothing, of several labels of an id the least counts; without labels
of both kinds the score is the share of label 1 (1 if there are none); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortkit.llm.common import crc32_mod, text_batches, text_span

PASSAGE = 64  # words
HASHED = 64


def _kinds() -> np.ndarray:
    """Byte -> kind: lower, upper, digit, space, line end, lead and trail bytes of UTF-8, each ASCII mark by itself."""
    k = np.zeros(256, np.int64)
    k[ord("a"):ord("z") + 1] = 1
    k[ord("A"):ord("Z") + 1] = 2
    k[ord("0"):ord("9") + 1] = 3
    k[[9, 11, 12, 13, 32]] = 4
    k[10] = 5
    k[128:192] = 6
    k[192:] = 7
    marks = [c for c in range(33, 127) if not chr(c).isalnum()]
    k[marks] = 8 + np.arange(len(marks))
    return k


KIND = _kinds()
N_KINDS = int(KIND.max()) + 1
COARSE = np.minimum(KIND, 8)  # for successions: all marks together
WIDTH = N_KINDS + 81 + HASHED + 6
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, passages of each text)."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    lens = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    ends = np.cumsum(lens)
    white = SPACE[buf]
    begins = ~white
    begins[1:] &= white[:-1]
    at = np.flatnonzero(begins)
    stop = np.flatnonzero(white[1:] & ~white[:-1]) + 1 if len(at) else np.zeros(0, np.int64)
    size = stop - at
    owner = np.searchsorted(ends, at, side="right")
    n_words = np.bincount(owner, minlength=len(texts))
    count = np.maximum(1, -(-n_words // PASSAGE))
    base = np.cumsum(count) - count
    nth = np.arange(len(at)) - (np.cumsum(n_words) - n_words)[owner]
    p_word = base[owner] + nth // PASSAGE
    total = int(count.sum())
    # a byte belongs to the passage of the last word that began in its text
    step = np.zeros(len(buf), np.int64)
    step[ends[:-1]] = 1
    step[at[(nth % PASSAGE == 0) & (nth > 0)]] += 1
    p_byte = np.cumsum(step)
    out = np.zeros((total, WIDTH), np.float32)
    n_bytes = np.maximum(np.bincount(p_byte, minlength=total), 1)[:, None]
    out[:, :N_KINDS] = np.bincount(p_byte * N_KINDS + KIND[buf], minlength=total * N_KINDS).reshape(total, -1) / n_bytes
    pair = COARSE[buf[:-1]] * 9 + COARSE[buf[1:]]
    own = np.ones(len(pair), bool)
    own[ends[:-1] - 1] = False  # not from one text to the next
    out[:, N_KINDS:N_KINDS + 81] = np.bincount((p_byte[:-1] * 81 + pair)[own],
                                               minlength=total * 81).reshape(total, -1) / n_bytes
    c = N_KINDS + 81
    out[:, -1] = np.log1p(1)
    if len(at):
        # a word's hash: the sum of its bytes, each times an odd number of its place
        place = np.arange(len(buf)) - np.maximum.accumulate(np.where(begins, np.arange(len(buf)), 0))
        v = (buf.astype(np.uint32) + np.uint32(1)) * (place.astype(np.uint32) * np.uint32(2654435761) + np.uint32(40503) | np.uint32(1))
        v[white] = 0
        h = np.add.reduceat(v, at).astype(np.uint32)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(2246822519)
        h ^= h >> np.uint32(13)
        nw = np.maximum(np.bincount(p_word, minlength=total), 1)
        out[:, c:c + HASHED] = np.bincount(p_word * HASHED + (h % HASHED).astype(np.int64),
                                           minlength=total * HASHED).reshape(total, -1) / nw[:, None]
        c += HASHED
        mean = np.bincount(p_word, size, total) / nw
        out[:, c] = mean
        out[:, c + 1] = np.sqrt(np.maximum(np.bincount(p_word, size.astype(float) ** 2, total) / nw - mean ** 2, 0))
        key = np.sort((p_word.astype(np.uint64) << np.uint64(32)) | h.astype(np.uint64))
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        out[:, c + 2] = np.bincount((key[fresh] >> np.uint64(32)).astype(np.int64), minlength=total) / nw
        again = np.zeros(len(h))
        again[1:] = (h[1:] == h[:-1]) & (p_word[1:] == p_word[:-1])
        out[:, c + 3] = np.bincount(p_word, again, total) / nw
        out[:, c + 4] = np.bincount(p_word, size == 1, total) / nw
        out[:, c + 5] = np.log1p(nw)
    return out, count


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Encoder W, gated attention V, U, a, output o; features are standardised."""

    NAMES = ("mean", "std", "W", "b", "V", "U", "a", "o", "c")

    def __init__(self, **p):
        self.p = {k: np.asarray(v, np.float32) for k, v in p.items()}

    def score(self, x: np.ndarray, count: np.ndarray) -> np.ndarray:
        p = self.p
        if not len(p["W"]):
            return np.full(len(count), float(p["c"][0]))
        h = np.tanh(((x - p["mean"]) / p["std"]).clip(-8, 8) @ p["W"] + p["b"])
        s = (np.tanh(h @ p["V"]) * _sigmoid(h @ p["U"])) @ p["a"]
        first = np.cumsum(count) - count
        w = np.exp(s - np.repeat(np.maximum.reduceat(s, first), count))
        z = np.add.reduceat(h * w[:, None], first, axis=0) / np.add.reduceat(w, first)[:, None]
        return _sigmoid(z @ p["o"] + p["c"]).astype(np.float64)


def fit(x: np.ndarray, count: np.ndarray, y: np.ndarray, hidden: int = 24, gate: int = 12, rounds: int = 250,
        rate: float = 0.02, decay: float = 1e-4, seed: int = 3, weight: np.ndarray | None = None) -> Model:
    """Full-batch Adam on the documents' (weighted) log loss."""
    y = y.astype(np.float32)
    weight = np.ones(len(y), np.float32) if weight is None else weight.astype(np.float32)
    if not len(y) or y.min() == y.max():
        return Model(mean=[], std=[], W=[], b=[], V=[], U=[], a=[], o=[], c=[float(y.mean()) if len(y) else 1.0])
    rng = np.random.default_rng(seed)
    mean, std = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = ((x - mean) / std).clip(-8, 8).astype(np.float32)
    d = x.shape[1]
    q = {"W": rng.normal(0, d ** -0.5, (d, hidden)), "b": np.zeros(hidden), "V": rng.normal(0, 0.3, (hidden, gate)),
         "U": rng.normal(0, 0.3, (hidden, gate)), "a": rng.normal(0, 0.3, gate), "o": rng.normal(0, 0.3, hidden),
         "c": np.zeros(1)}
    q = {k: v.astype(np.float32) for k, v in q.items()}
    m1, m2 = ({k: np.zeros_like(v) for k, v in q.items()} for _ in range(2))
    first = np.cumsum(count) - count
    doc = np.repeat(np.arange(len(count)), count)
    for step in range(1, rounds + 1):
        h = np.tanh(x @ q["W"] + q["b"])
        t, g = np.tanh(h @ q["V"]), _sigmoid(h @ q["U"])
        s = (t * g) @ q["a"]
        w = np.exp(s - np.maximum.reduceat(s, first)[doc])
        w /= np.add.reduceat(w, first)[doc]
        z = np.add.reduceat(h * w[:, None], first, axis=0)
        dy = (_sigmoid(z @ q["o"] + q["c"]) - y) * weight / weight.sum()
        dz = dy[:, None] * q["o"]
        dw = (h * dz[doc]).sum(axis=1)
        ds = w * (dw - np.add.reduceat(w * dw, first)[doc])
        dt, dg = ds[:, None] * q["a"] * g * (1 - t * t), ds[:, None] * q["a"] * t * g * (1 - g)
        dh = (w[:, None] * dz[doc] + dt @ q["V"].T + dg @ q["U"].T) * (1 - h * h)
        grad = {"W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "a": (t * g).T @ ds,
                "o": z.T @ dy, "c": dy.sum(keepdims=True)}
        for k in q:
            gk = grad[k] + decay * q[k] * (k not in ("b", "c"))
            m1[k] = 0.9 * m1[k] + 0.1 * gk
            m2[k] = 0.999 * m2[k] + 0.001 * gk * gk
            q[k] = q[k] - rate * (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.999 ** step)) + 1e-8)
    return Model(mean=mean, std=std, **q)


def class_shares(sizes: dict[int, int], most: int) -> dict[int, float]:
    """Share of each class to draw: ``most`` rows in all, dealt evenly, what small classes leave goes to the others."""
    out, left = {}, most
    for k, (c, n) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        out[c] = min(1.0, left / (len(sizes) - k) / n)
        left -= min(n, left / (len(sizes) - k))
    return out


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id",
          label_col: str = "quality", max_docs: int = 3000, max_chars: int = 40_000, rounds: int = 250) -> Model:
    """Fit in one task on about ``max_docs`` labelled texts, drawn per class by a hash of the id.

    A class of few rows is drawn whole; rows weigh as many labelled ones as they stand for, so the loss is that of all.
    Of long texts ``max_chars`` characters are read.
    """
    lab = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(
        F.col(id_col).alias("__id")).agg(F.min(label_col).cast("int").alias("__y"))
    sizes = {r[0]: r[1] for r in lab.groupBy("__y").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per class
    shares = class_shares(sizes, max_docs)
    share = F.element_at(F.create_map(*[F.lit(v) for kv in shares.items() for v in kv]), F.col("__y")) if shares else F.lit(1.0)
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col("__id")), F.lit(1 << 20)) / float(1 << 20)
    lab = lab.withColumn("__share", share).filter(draw < F.col("__share"))  # about max_docs rows of three numbers: broadcast
    sample = docs.join(F.broadcast(lab), F.col(id_col) == F.col("__id")).select(
        text_span(F.col(text_col), F.col("__id"), max_chars).alias("text"), F.col("__y").alias("y"),
        (1 / F.col("__share")).alias("weight"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((t or "", y, w) for b in batches for t, y, w in zip(*[c.to_pylist() for c in b.columns]))
        if rows:
            x, count = passages([r[0].encode() for r in rows])
            m = fit(x, count, np.array([r[1] for r in rows]), rounds=rounds, weight=np.array([r[2] for r in rows]))
        else:
            m = fit(np.zeros((0, WIDTH)), np.zeros(0, np.int64), np.zeros(0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(m.p)), pa.array([v.shape for v in m.p.values()], pa.list_(pa.int32())),
             pa.array([v.ravel() for v in m.p.values()], pa.list_(pa.float32()))], ["name", "shape", "v"])

    got = sample.repartition(1).mapInArrow(run, "name string, shape array<int>, v array<float>").collect()
    if not got:
        return fit(np.zeros((0, WIDTH)), np.zeros(0, np.int64), np.zeros(0))
    return Model(**{r["name"]: np.array(r["v"], np.float32).reshape(r["shape"]) for r in got})


def score_texts(model: Model, texts: list[str | None]) -> np.ndarray:
    x, count = passages([(t or "").encode() for t in texts])
    return model.score(x, count)


def score(docs: DataFrame, model: Model, keys: list[str], text_col: str = "text") -> DataFrame:
    """Keys and the score of each text."""
    fields = [docs.schema[k] for k in keys] + [T.StructField("score", T.DoubleType())]
    p = model.p

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(**p)
        for b in text_batches(batches, "__text", 1 << 20):
            s = score_texts(m, b.column(len(keys)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keys)], pa.array(s)], [f.name for f in fields])

    return docs.select(*keys, F.col(text_col).alias("__text")).mapInArrow(run, T.StructType(fields))


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that score ``threshold`` or more, with all their columns."""
    p = model.p

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(**p)
        for b in text_batches(batches, text_col, 1 << 20):
            i = b.schema.get_field_index(text_col)
            yield b.filter(pa.array(score_texts(m, b.column(i).to_pylist()) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, threshold: float = 0.7,
             max_docs: int = 3000) -> DataFrame:
    """doc_id, held_out, score, predicted; learned from rows whose crc32(doc_id) mod ``folds`` is not ``fold``."""
    own = crc32_mod(F.col("doc_id"), folds)
    model = train(docs.filter(own != fold), labels.filter(own != fold), max_docs=max_docs)
    d = docs.select("doc_id", F.coalesce(own == fold, F.lit(False)).alias("held_out"), "text")
    s = score(d, model, ["doc_id", "held_out"])
    return s.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
