"""Language identification with a linear-chain conditional random field.

Words (runs of letters, lower-cased) are labelled with languages.  A word's emission
is a sum of learned weights of its features: prefixes and suffixes of one to three letters
(affixes), all runs of two and three letters, and the whole word (lexicon); features are hashed into
one weight table.  Transitions between the labels of successive words are learned too.
Forward-backward gives the posterior of each label at each word, also where languages
change inside a text; a text's label is the one with the largest mean posterior, which is its score.

Training texts carry one label each, so training sequences are spliced: spans of texts of
different languages follow one another, which is what the transitions are learned from.  The sample is
bounded by ``max_docs`` per language (texts longer than ``max_chars`` are not drawn for it); the statistics of prediction
cover every word of every text.  Weights are fitted in one task and travel as one bounded array.

Long texts are cut into blocks of 64 words whose transfer matrices are multiplied, so all
blocks of a batch advance together and the result is that of the whole chain.

Defined cases: NULL text, or none with a letter: ``und`` and score 0; no labelled rows: every text is
``und``; NULL ids are never drawn for training and count as not held out; ties go to the label
first in order; repeated rows are independent; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortkit.llm.common import crc32_mod, ranges, text_batches, text_span

LETTERS = re.compile(r"[^\W\d_]+")
BLOCK = 64
WEIGHTS = 1 << 17


def words_of(text: str) -> list[str]:
    found = LETTERS.findall(text.lower())
    # word characters that are numbers of other kinds (superscripts, fractions) are no letters
    return found if text.isascii() else [w for w in found if any(c.isalpha() for c in w)]


class Tokens:
    """Distinct white-space tokens seen so far, as runs of word numbers; words have their emissions."""

    def __init__(self, model):
        self.model, self.code, self.word = model, {}, {}
        self.lens = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int64)
        self.table = np.zeros((len(model.labels), 0))

    def look_up(self, tokens: list[str], owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(emissions of all words, owner of each) for tokens and their owners."""
        new = list(set(tokens).difference(self.code))
        if new:
            split = [words_of(x) for x in new]
            fresh = list({w for ws in split for w in ws if w not in self.word})
            if fresh:
                self.word.update(zip(fresh, range(len(self.word), len(self.word) + len(fresh))))
                self.table = np.concatenate([self.table, self.model.emissions(fresh)], axis=1)
            self.code.update(zip(new, range(len(self.code), len(self.code) + len(new))))
            self.lens = np.concatenate([self.lens, np.fromiter(map(len, split), np.int64, len(split))])
            self.flat = np.concatenate([self.flat, np.array([self.word[w] for ws in split for w in ws], np.int64)])
        at = np.fromiter(map(self.code.__getitem__, tokens), np.int64, len(tokens))
        n = self.lens[at]
        return np.take(self.table, self.flat[ranges((np.cumsum(self.lens) - self.lens)[at], n)], axis=1), np.repeat(owner, n)


def _hash(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.int64) & (WEIGHTS - 1)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word index, feature slot) of all features of the words."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    who, slot = [], []
    size = 1
    while len(words) and size < 2 * lens.max():  # words of like length together, whatever their length
        size *= 2
        at = np.flatnonzero((lens <= size) & (lens > size // 2))
        if not len(at):
            continue
        c = np.array([words[i] for i in at], dtype=f"U{size}").view(np.uint32).reshape(len(at), size).astype(np.uint64)
        n = lens[at]
        whole = np.zeros(len(at), np.uint64)
        for j in range(size):
            whole = np.where(j < n, whole * np.uint64(1000003) + c[:, j] + np.uint64(1), whole)
        who.append(at)
        slot.append(_hash(whole, 1))
        for k in (1, 2, 3):
            pre, suf = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
            for j in range(min(k, size)):
                pre = pre * np.uint64(0x110000) + c[:, j]
                suf = suf * np.uint64(0x110000) + c[np.arange(len(at)), np.maximum(n - k + j, 0)]
            ok = n >= k
            who += [at[ok], at[ok]]
            slot += [_hash(pre[ok], 10 + k), _hash(suf[ok], 20 + k)]
        for k in (2, 3):
            for j in range(size - k + 1):
                ok = n >= j + k
                if not ok.any():
                    break
                g = np.zeros(int(ok.sum()), np.uint64)
                for q in range(k):
                    g = g * np.uint64(0x110000) + c[ok, j + q]
                who.append(at[ok])
                slot.append(_hash(g, 30 + k))
    if not who:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(who), np.concatenate(slot)


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # (labels, WEIGHTS)
    transitions: np.ndarray  # (labels, labels)

    def emissions(self, words: list[str]) -> np.ndarray:
        who, slot = features(words)
        n = np.maximum(np.bincount(who, minlength=len(words)), 1)
        return np.array([np.bincount(who, self.weights[k, slot], len(words)) / np.sqrt(n)
                         for k in range(len(self.labels))]).reshape(len(self.labels), len(words))


def _normal(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(x.sum(axis=0), 1e-300)


def posteriors(emit: np.ndarray, counts: np.ndarray, trans: np.ndarray,
               pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over chains that lie one after the other.

    emit: (L, words) scores; counts: words (one or more) of each chain.  Returns the posterior of each label
    at each word (L, words), and (``pairs``) the summed posterior of each pair of successive labels (L, L).
    """
    size, n = emit.shape
    pair = np.zeros((size, size))
    if not n:
        return emit, pair
    tr = np.exp(trans - trans.max())
    e = np.exp(np.maximum(emit - emit.max(axis=0), -60.0))
    blocks = -(-counts // BLOCK)
    nb, most = int(blocks.sum()), int(blocks.max())
    chain = np.repeat(np.arange(len(counts)), blocks)
    b0 = np.cumsum(blocks) - blocks
    nth = np.arange(nb) - b0[chain]
    first = (np.cumsum(counts) - counts)[chain] + nth * BLOCK
    length = np.minimum(BLOCK, counts[chain] - nth * BLOCK)
    # longest blocks first: those that have a t-th word are then a prefix
    order = np.argsort(-length, kind="stable")
    rank = np.empty(nb, np.int64)
    rank[order] = np.arange(nb)
    first, length = first[order], length[order]
    live = nb - np.searchsorted(length[::-1], np.arange(BLOCK), side="right")
    steps = int(length[0])
    ev = [np.take(e, first[:live[t]] + t, axis=1) for t in range(steps)]

    start = np.full((size, nb), 1.0 / size)
    end = np.ones((size, nb))
    if most > 1:
        # transfer matrix of each block: first index the label before it, second its last label
        move = np.zeros((size, size, nb))
        move[np.arange(size), np.arange(size)] = 1
        for t in range(steps):
            m = live[t]
            for i in range(size):
                np.multiply(tr.T @ move[i, :, :m], ev[t], out=move[i, :, :m])
            if t % 8 == 7:
                move[:, :, :m] /= np.maximum(move[:, :, :m].max(axis=(0, 1)), 1e-300)
        move /= np.maximum(move.max(axis=(0, 1)), 1e-300)
        # label vectors at the borders of blocks, chain by chain in step
        for k in range(1, most):
            at = b0[blocks > k] + k
            start[:, rank[at]] = _normal(np.einsum("in,ijn->jn", start[:, rank[at - 1]], move[:, :, rank[at - 1]]))
        for k in range(most - 2, -1, -1):
            at = b0[blocks > k + 1] + k
            end[:, rank[at]] = _normal(np.einsum("ijn,jn->in", move[:, :, rank[at + 1]], end[:, rank[at + 1]]))
    fwd = []
    a = start
    for t in range(steps):
        a = (tr.T @ a[:, :live[t]]) * ev[t]
        if t % 8 == 7:
            a = _normal(a)
        fwd.append(a)
    post = np.empty((size, n))
    b = end
    opens = nth[order] == 0
    for t in range(steps - 1, -1, -1):
        m = live[t]
        post[:, first[:m] + t] = fwd[t] * b[:, :m]
        eb = ev[t] * b[:, :m]
        if pairs:
            before = (fwd[t - 1][:, :m] if t else start).copy()
            before /= np.maximum(((tr.T @ before) * eb).sum(axis=0), 1e-300)
            if not t:
                before[:, opens] = 0  # nothing comes before a chain's first word
            pair += tr * (before @ eb.T)
        eb = tr @ eb
        if t % 8 == 0:
            eb = _normal(eb)
        if m == nb:
            b = eb
        else:
            b = b.copy()
            b[:, :m] = eb
    return _normal(post), pair


def fit(texts: list[str], langs: list[str], rounds: int = 30, rate: float = 0.5, seed: int = 7) -> Model:
    """Weights by AdaGrad on the spliced sequences' log-likelihood."""
    labels = sorted(set(langs))
    rng = np.random.default_rng(seed)
    code: dict[str, int] = {}
    spans = []
    for i in rng.permutation(len(texts)):
        w = [code.setdefault(x, len(code)) for x in words_of(texts[i])]
        k, s = labels.index(langs[i]), 0
        while s < len(w):
            n = int(rng.integers(8, 160))
            spans.append((np.array(w[s:s + n]), k))
            s += n
    if not spans:
        return Model([], np.zeros((0, WEIGHTS)), np.zeros((0, 0)))
    spans = [spans[i] for i in rng.permutation(len(spans))]
    word = np.concatenate([w for w, _ in spans])
    gold = np.concatenate([np.full(len(w), k) for w, k in spans])
    per_chain = 4
    sizes = np.array([len(w) for w, _ in spans])
    counts = np.add.reduceat(sizes, np.arange(0, len(sizes), per_chain))
    model = Model(labels, np.zeros((len(labels), WEIGHTS)), np.zeros((len(labels), len(labels))))
    who, slot = features(list(code))
    scale = 1 / np.sqrt(np.maximum(np.bincount(who, minlength=len(code)), 1))
    size = len(labels)
    ends = np.zeros(len(word), bool)
    ends[np.cumsum(counts) - 1] = True
    gold_pair = np.zeros((size, size))
    np.add.at(gold_pair, (gold[:-1][~ends[:-1]], gold[1:][~ends[:-1]]), 1)
    gw, gt = np.full(model.weights.shape, 1e-8), np.full((size, size), 1e-8)
    onehot = np.zeros((size, len(word)))
    onehot[gold, np.arange(len(word))] = 1
    for _ in range(rounds):
        table = np.stack([np.bincount(who, model.weights[k, slot], len(code)) * scale for k in range(size)])
        post, pair = posteriors(table[:, word], counts, model.transitions, pairs=True)
        diff = onehot - post
        by_word = [np.bincount(word, diff[k], len(code)) * scale for k in range(size)]
        grad = np.stack([np.bincount(slot, by_word[k][who], WEIGHTS) for k in range(size)]) / len(word)
        grad -= 1e-7 * model.weights
        gw += grad * grad
        model.weights += rate * grad / np.sqrt(gw)
        g = (gold_pair - pair) / len(word) - 1e-5 * model.transitions
        gt += g * g
        model.transitions += rate * g / np.sqrt(gt)
    return model


def training_sample(docs: DataFrame, label_col: str, text_col: str, max_docs: int, max_chars: int) -> DataFrame:
    """(text, label): about ``max_docs`` rows per label, chosen by a hash of the id; of long texts ``max_chars`` characters."""
    d = docs.filter(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in d.groupBy(label_col).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return d.select(F.col(text_col).alias("text"), F.col(label_col).alias("label")).limit(0)
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, min(1.0, max_docs / n))]),
                         F.col(label_col))
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id")), F.lit(1 << 20)) / float(1 << 20)
    return d.filter(draw < share).select(
        text_span(F.col(text_col), F.col("doc_id"), max_chars).alias("text"), F.col(label_col).alias("label"))


def train(docs: DataFrame, text_col: str = "text", label_col: str = "lang", max_docs: int = 300,
          max_chars: int = 20_000, rounds: int = 30) -> Model:
    """Fit on a sample of at most about ``max_docs`` texts per language, in one task."""
    sample = training_sample(docs, label_col, text_col, max_docs, max_chars)

    def run(tabs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, langs = [], []
        for b in tabs:
            texts += b.column(0).to_pylist()
            langs += b.column(1).to_pylist()
        order = sorted(range(len(texts)), key=lambda i: (langs[i], texts[i]))
        m = fit([texts[i] for i in order], [langs[i] for i in order], rounds)
        yield pa.RecordBatch.from_arrays(
            [pa.array([m.labels], pa.list_(pa.string())),
             pa.array([m.weights.astype(np.float32).tobytes()], pa.binary()),
             pa.array([m.transitions.astype(np.float64).tobytes()], pa.binary())], ["labels", "w", "t"])

    got = sample.repartition(1).mapInArrow(run, "labels array<string>, w binary, t binary").collect()
    if not got:
        return Model([], np.zeros((0, WEIGHTS)), np.zeros((0, 0)))
    k = len(got[0]["labels"])
    return Model(list(got[0]["labels"]), np.frombuffer(bytes(got[0]["w"]), np.float32).reshape(k, WEIGHTS),
                 np.frombuffer(bytes(got[0]["t"]), np.float64).reshape(k, k))


def predict(docs: DataFrame, model: Model, keys: list[str], text_col: str = "text",
            max_words: int = 300_000) -> DataFrame:
    """Keys, lang_pred, score, and the share of words of another label (``mixed``)."""
    fields = [docs.schema[k] for k in keys] + [
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("mixed", T.DoubleType())]
    shared = docs.sparkSession.sparkContext.broadcast((model.labels, model.weights, model.transitions))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        seen = Tokens(m)
        for b in text_batches(batches, "__text", 1 << 20):
            tokens, n = [], np.zeros(b.num_rows, np.int64)
            for i, t in enumerate(b.column(len(keys)).to_pylist()):
                w = t.lower().split() if t else []
                n[i] = len(w)
                tokens += w
            if len(seen.code) > max_words:  # bounds the table; the texts that follow fill it anew
                seen = Tokens(m)
            emit, owner = seen.look_up(tokens, np.repeat(np.arange(b.num_rows), n))
            counts = np.bincount(owner, minlength=b.num_rows)
            best, score, mixed = np.zeros(b.num_rows, int), np.zeros(b.num_rows), np.zeros(b.num_rows)
            some = counts > 0
            if some.any() and m.labels:
                post, _ = posteriors(emit, counts[some], m.transitions)
                starts = (np.cumsum(counts) - counts)[some]
                mean = np.add.reduceat(post, starts, axis=1) / counts[some]
                best[some] = mean.argmax(axis=0)
                score[some] = np.clip(mean.max(axis=0), 0.0, 1.0)
                other = post.argmax(axis=0) != np.repeat(best[some], counts[some])
                mixed[some] = np.add.reduceat(other.astype(float), starts) / counts[some]
            known = bool(m.labels)
            pred = [m.labels[k] if ok and known else "und" for k, ok in zip(best, some)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:len(keys)], pa.array(pred, pa.string()), pa.array(score), pa.array(mixed)],
                [f.name for f in fields])

    return docs.select(*keys, F.col(text_col).alias("__text")).mapInArrow(run, T.StructType(fields))


def identify(docs: DataFrame, folds: int = 5, max_docs: int = 300) -> DataFrame:
    """doc_id, held_out, lang_pred, score, mixed; learned from rows whose crc32(doc_id) mod ``folds`` is not 0."""
    fold = crc32_mod(F.col("doc_id"), folds)
    model = train(docs.filter(fold != 0), max_docs=max_docs)
    d = docs.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "text")
    return predict(d, model, ["doc_id", "held_out"])
