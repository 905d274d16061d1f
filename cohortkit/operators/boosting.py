"""Logistic boosted trees grown over one binned table, all fits of a grid in the same passes.

A fit's first n trees are those of a fit of n trees, so grid points that differ in the number of trees are stages of one
chain.  Every chain (horizon, fold, depth, step) of a search advances together: a pass over the binned rows adds one level to
the current tree of every chain.  Rows are binned once (a byte a value) and written as blocks of bounded size; a block keeps the
margins of its rows, its histograms are summed by (chain, node) in a shuffle, the best split of a node is found where its
histogram ends up, and only splits (a row a node) reach the driver.  A table of a single block needs no such sum, so its
task grows a few trees between two jobs; idle cores then share the chains.

Gradients are whole multiples of 2^-24, so sums do not depend on the blocks, the order of rows or on tasks that run again.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import StorageLevel, TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from cohortkit.operators.metrics import roc_auc
from cohortkit.operators.summaries import top_k
from cohortkit.session import checkpoint_dir, materialize, release

SCALE = float(1 << 24)
LAMBDA, MIN_HESSIAN, MIN_GAIN = 1.0, 1.0, 1e-6  # leaf penalty, least weight of a child, least gain of a split
NONE = 255  # a label or fold that is NULL


class Chain(NamedTuple):
    """One boosted fit: rows of ``target`` outside ``fold`` (-1: all rows), with or without their weights."""
    target: int
    fold: int
    depth: int
    step: float
    weighted: bool = True


class Tree(NamedTuple):
    """Heap order: the children of i are 2i + 1 (bin or value at most the cut) and 2i + 2; feature -1 is a leaf."""
    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray


class Binned(NamedTuple):
    blocks: DataFrame  # one row a block
    count: int
    cuts: list  # per feature, ascending


def _values(df: DataFrame, features: str) -> Column:
    c = F.col(features)
    return c if isinstance(df.schema[features].dataType, ArrayType) else vector_to_array(c)


def _cuts(x: DataFrame, p: int, max_bins: int) -> list:
    """Cuts per feature: the least value and approximate quantiles, all below the greatest (one scan for all features)."""
    at = [i / max_bins for i in range(1, max_bins)]
    aggs = []
    for j in range(p):
        v = F.get("x", F.lit(j))
        v = F.when(~F.isnan(v), v)
        aggs += [F.min(v).alias(f"lo{j}"), F.max(v).alias(f"hi{j}"), F.percentile_approx(v, at, 10000).alias(f"q{j}")]
    if not p:
        return []
    row = x.agg(*aggs).first()
    return [np.array(sorted({v for v in [row[f"lo{j}"], *(row[f"q{j}"] or [])] if v is not None and v < row[f"hi{j}"]}), float)
            for j in range(p)]


def bin_rows(df: DataFrame, targets: Sequence[tuple], features: str = "features", max_bins: int = 64,
             cells: int = 1 << 22, rows: int = 1 << 18) -> Binned:
    """Blocks of about ``cells`` feature values, but ``rows`` rows at most, whose margins and gradients outweigh few features;
    ``targets`` are (label, weight or None, fold or None) column names.

    Labels are 0 or 1; rows whose label is NULL take no part in that target.  NaN counts as the greatest value.
    """
    if not 2 <= max_bins <= 255:
        raise ValueError("max_bins must lie in 2 .. 255")

    def small(c):
        return F.coalesce(F.col(c).cast("int"), F.lit(NONE)) if c else F.lit(NONE)

    x = df.select(_values(df, features).alias("x"), F.array(*[small(t[0]) for t in targets]).alias("y"),
                  F.array(*[F.col(t[1]).cast("double") if t[1] else F.lit(1.0) for t in targets]).alias("w"),
                  F.array(*[small(t[2]) for t in targets]).alias("f"))
    x = materialize(x, "boost-rows")
    first = x.select("x").first()
    p = len(first["x"]) if first else 0
    cuts = _cuts(x, p, max_bins)
    size = x.count()
    count = max(1, -(-size * p // cells), -(-size // rows))

    def pack(batches):
        parts = []
        for b in batches:
            if len(b):
                v = np.stack(b["x"].to_numpy())
                bins = np.empty(v.shape, np.uint8)
                for j, c in enumerate(cuts):
                    bins[:, j] = np.searchsorted(c, v[:, j], "left")
                parts.append((bins, np.stack(b["y"].to_numpy()).astype(np.uint8), np.stack(b["w"].to_numpy()),
                              np.stack(b["f"].to_numpy()).astype(np.uint8)))
        if parts:
            x, y, w, f = (np.concatenate(a) for a in zip(*parts))
            yield pd.DataFrame([{"block": TaskContext.get().partitionId(), "n": len(x), "x": x.tobytes(),
                                 "y": y.T.tobytes(), "w": w.T.tobytes(), "f": f.T.tobytes()}])

    blocks = materialize(x.repartition(count).mapInPandas(pack, "block int, n int, x binary, y binary, w binary, f binary"),
                         "boost-blocks", frees=(x,))
    return Binned(blocks, count, cuts)


class Layout:
    """Where each feature's bins lie in a histogram row."""

    def __init__(self, cuts):
        size = np.array([len(c) + 1 for c in cuts], np.int64)
        self.start = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int32)
        self.total = int(size.sum())
        self.feature = np.repeat(np.arange(len(cuts)), size)
        self.last = np.zeros(self.total, bool)
        self.last[self.start + size - 1] = True
        self.first_end = int(size[0]) - 1


def gradients(margin, y, w, f, ch: Chain):
    """First and second derivatives of the log loss in units of 2^-24, and the rows that the chain learns from."""
    rows = np.flatnonzero((y <= 1) & ((f != ch.fold) if ch.fold >= 0 else True))
    p = 1 / (1 + np.exp(-margin[rows]))
    weight = w[rows] if ch.weighted else 1.0
    return rows, np.rint(weight * (p - y[rows]) * SCALE), np.rint(weight * p * (1 - p) * SCALE)


def descend(x, node, tree: Tree):
    """One level down."""
    f = tree.feature[node]
    right = x[np.arange(len(x)), np.maximum(f, 0)] > tree.bin[node]
    return np.where(f >= 0, 2 * node + 1 + right, node)


def histograms(xo, node, active, g, h, total, cells: int = 1 << 21):
    """(nodes, gradient sums, hessian sums) per bin for the ``active`` nodes, some nodes at a time."""
    slot = np.full(max(int(node.max(initial=0)), max(active)) + 1, -1, np.int64)
    slot[active] = np.arange(len(active))
    at = slot[node]
    many = max(1, cells // total)
    for lo in range(0, len(active), many):
        size = min(many, len(active) - lo)
        r = np.flatnonzero((at >= lo) & (at < lo + size))
        flat = (xo[r] + ((at[r] - lo) * total)[:, None]).ravel()
        sums = [np.bincount(flat, np.repeat(v[r], xo.shape[1]), size * total).astype(np.int64).reshape(size, total)
                for v in (g, h)]
        yield active[lo:lo + size], *sums


def best_splits(hg, hh, lay: Layout):
    """Per histogram row: (feature or -1, bin, g and h left of it, g and h of the node); ties go to the first bin."""
    def left(a):
        c = np.cumsum(a, axis=1)
        before = np.where(lay.start > 0, c[:, lay.start - 1], 0)
        return (c - before[:, lay.feature]) / SCALE, (c[:, lay.first_end] / SCALE)[:, None]

    (gl, g), (hl, h) = left(hg), left(hh)
    gain = gl ** 2 / (hl + LAMBDA) + (g - gl) ** 2 / (h - hl + LAMBDA) - g ** 2 / (h + LAMBDA)
    gain[(hl < MIN_HESSIAN) | (h - hl < MIN_HESSIAN) | lay.last] = -np.inf
    k = gain.argmax(axis=1)
    i = np.arange(len(k))
    f = np.where(gain[i, k] > MIN_GAIN, lay.feature[k], -1)
    return list(zip(f.tolist(), (k - lay.start[lay.feature[k]]).tolist(), gl[i, k].tolist(), hl[i, k].tolist(),
                    g[:, 0].tolist(), h[:, 0].tolist()))


def seedling(depth: int) -> Tree:
    n = (2 << depth) - 1
    return Tree(np.full(n, -1, np.int16), np.zeros(n, np.uint8), np.zeros(n))


def split(tree: Tree, node: int, s: tuple, step: float) -> list[int]:
    """Record a split; returns the children."""
    f, cut, gl, hl, g, h = s
    if node == 0:
        tree.value[0] = -step * g / (h + LAMBDA)
    if f < 0:
        return []
    a, b = 2 * node + 1, 2 * node + 2
    tree.feature[node], tree.bin[node] = f, cut
    tree.value[a], tree.value[b] = -step * gl / (hl + LAMBDA), -step * (g - gl) / (h - hl + LAMBDA)
    return [a, b]


def grow(x, xo, margin, y, w, f, ch: Chain, lay: Layout) -> Tree:
    """A whole tree from a block that holds all rows."""
    rows, g, h = gradients(margin, y, w, f, ch)
    tree, active, node = seedling(ch.depth), [0], np.zeros(len(rows), np.int64)
    xr, xor = x[rows], xo[rows]
    for _ in range(ch.depth):
        nxt = []
        for nodes, hg, hh in histograms(xor, node, active, g, h, lay.total):
            for n, s in zip(nodes, best_splits(hg, hh, lay)):
                nxt += split(tree, n, s, ch.step)
        if not nxt:
            break
        active, node = nxt, descend(xr, node, tree)
    return tree


def leaf_values(x, tree: Tree, depth: int):
    node = np.zeros(len(x), np.int64)
    for _ in range(depth):
        node = descend(x, node, tree)
    return tree.value[node]


def fit(binned: Binned, chains: Sequence[Chain], stages: Sequence[int], every: int = 10,
        scored: list | None = None) -> list[tuple[float, list[Tree]]]:
    """(base margin, trees) of each chain; the most trees of ``stages`` are grown.

    At each stage, ``scored`` (if given) gets a written table (chain, trees, y, score) of the rows of the chains' own folds.
    Margins are checkpointed every ``every`` trees, so a lost executor costs at most that many passes.
    """
    spark = binned.blocks.sparkSession
    sc = spark.sparkContext
    checkpoint_dir(spark)
    if not binned.cuts or not chains:
        return [(0.0, []) for _ in chains]
    lay, p, alone = Layout(binned.cuts), len(binned.cuts), binned.count == 1
    groups = max(1, min(len(chains), sc.defaultParallelism // binned.count))
    chains = list(chains)

    def deal(r):
        return r.n, r.x, r.y, r.w, r.f, list(range(r.g, len(chains), groups))

    def unpack(b):
        n, x, y, w, f, ids = b
        return (np.frombuffer(x, np.uint8).reshape(n, p), np.frombuffer(y, np.uint8).reshape(-1, n),
                np.frombuffer(w).reshape(-1, n), np.frombuffer(f, np.uint8).reshape(-1, n), ids)

    def counts(b):
        _, y, w, f, ids = unpack(b)
        for c in ids:
            t = chains[c].target
            rows, g, _ = gradients(np.zeros(len(y[t])), y[t], w[t], f[t], chains[c])
            total = np.rint(w[t][rows] * SCALE if chains[c].weighted else np.full(len(rows), SCALE))
            yield c, (int(total[y[t][rows] == 1].sum()), int(total.sum()))

    # a block a partition, dealt outside Python: its workers never hold the several blocks that one read task may get
    g = binned.blocks.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    dealt = g.repartitionById(binned.count * groups, (F.col("block") * groups + F.col("g")).cast("int")).rdd.map(deal)
    dealt.persist(StorageLevel.MEMORY_AND_DISK)
    sums = dict(dealt.flatMap(counts).reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1])).collect())  # a row a chain
    share = [min(max(sums.get(c, (0, 1))[0] / max(1, sums.get(c, (0, 1))[1]), 1e-6), 1 - 1e-6) for c in range(len(chains))]
    base = [float(np.log(s / (1 - s))) for s in share]

    def start(b):
        x, y, w, f, ids = unpack(b)
        return x, y, w, f, ids, np.repeat(np.array([base[c] for c in ids])[:, None], len(x), 1), []

    def several(k):
        def run(s):
            x, y, w, f, ids, margin, _ = s
            xo, margin, out = x.astype(np.int32) + lay.start, margin.copy(), []
            for i, c in enumerate(ids):
                t = chains[c].target
                for _ in range(k):
                    tree = grow(x, xo, margin[i], y[t], w[t], f[t], chains[c], lay)
                    margin[i] += leaf_values(x, tree, chains[c].depth)
                    out.append((c, tree))
            return x, y, w, f, ids, margin, out
        return run

    def level(trees, active, depth):
        def run(s):
            x, y, w, f, ids, margin, _ = s
            xo = x.astype(np.int32) + lay.start
            for i, c in enumerate(ids):
                if c in active:
                    t = chains[c].target
                    rows, g, h = gradients(margin[i], y[t], w[t], f[t], chains[c])
                    node = np.zeros(len(rows), np.int64)
                    for _ in range(depth):
                        node = descend(x[rows], node, trees[c])
                    for nodes, hg, hh in histograms(xo[rows], node, active[c], g, h, lay.total):
                        for n, a, b in zip(nodes, hg, hh):
                            yield (c, n), np.stack([a, b])
        return run

    def together(state):
        """One tree a chain, level by level."""
        trees = {c: seedling(ch.depth) for c, ch in enumerate(chains)}
        active = {c: [0] for c in trees}
        for depth in range(max(ch.depth for ch in chains)):
            active = {c: a for c, a in active.items() if a and depth < chains[c].depth}
            if not active:
                break
            sums = state.flatMap(level(trees, active, depth)).reduceByKey(np.add)
            best = sums.mapValues(lambda a: best_splits(a[:1], a[1:], lay)[0]).collect()  # a row a node
            active = defaultdict(list)
            for (c, n), s in sorted(best):
                active[c] += split(trees[c], n, s, chains[c].step)

        def add(s):
            x, y, w, f, ids, margin, _ = s
            return x, y, w, f, ids, margin + np.array([leaf_values(x, trees[c], chains[c].depth) for c in ids]), []

        return state.map(add), list(trees.items())

    def held(n):
        def run(s):
            _, y, _, f, ids, margin, _ = s
            for i, c in enumerate(ids):
                t = chains[c].target
                rows = (f[t] == chains[c].fold) & (y[t] <= 1) if chains[c].fold >= 0 else np.zeros(len(f[t]), bool)
                yield c, n, y[t][rows].tolist(), (1 / (1 + np.exp(-margin[i][rows]))).tolist()
        return run

    grown, done = defaultdict(list), 0
    state, kept, written = dealt.map(start), [], None
    for stop in sorted({*stages, *range(every, max(stages), every)}):
        while done < stop:
            if alone:
                state, new = state.map(several(stop - done)), None
                done = stop
            else:
                state, new = together(state)
                done += 1
            state.persist(StorageLevel.MEMORY_AND_DISK)
            if done == stop and stop < max(stages):
                state.checkpoint()
            got = state.flatMap(lambda s: s[-1]).collect()  # the new trees, and the margins are kept
            for c, tree in (new or got):
                grown[c].append(tree)
            for old in kept:
                old.unpersist()
            kept = [state]
        file = state.getCheckpointFile()
        if file:
            written = _drop(spark, written, file)
        if scored is not None and stop in stages:
            out = spark.createDataFrame(state.flatMap(held(stop)), "chain int, trees int, y array<int>, score array<double>")
            out = out.select("chain", "trees", F.explode(F.arrays_zip("y", "score")).alias("r"))
            scored.append(materialize(out.select("chain", "trees", "r.y", "r.score"), "boost-scores"))
    state.unpersist()
    dealt.unpersist()
    _drop(spark, written, None)
    return [(base[c], grown[c]) for c in range(len(chains))]


def _drop(spark: SparkSession, path: str | None, instead: str | None) -> str | None:
    """Delete a checkpoint that a later one replaces."""
    if path:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return instead


class Forest:
    """A fitted model; trees hold feature values as cuts."""

    def __init__(self, base: float, trees: Sequence[tuple], features: int):
        self.base, self.trees, self.numFeatures = base, list(trees), features

    @classmethod
    def of(cls, base: float, trees: Sequence[Tree], cuts: list) -> Forest:
        out = []
        for t in trees:
            cut = np.array([cuts[f][b] if f >= 0 else 0.0 for f, b in zip(t.feature, t.bin)])
            out.append((t.feature, cut, t.value))
        return cls(base, out, len(cuts))

    def margins(self, x: np.ndarray, trees: int | None = None) -> np.ndarray:
        m, i = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.trees[:trees]:
            node = np.zeros(len(x), np.int64)
            for _ in range(int(len(feature) + 1).bit_length() - 2):
                f = feature[node]
                node = np.where(f >= 0, 2 * node + 1 + ~(x[i, np.maximum(f, 0)] <= cut[node]), node)
            m += value[node]
        return m

    def nodes(self, spark: SparkSession) -> DataFrame:
        """One row a used node: tree, node (heap order), feature (-1 for a leaf), cut, value."""
        rows = []
        for t, (f, c, v) in enumerate(self.trees):
            used = np.zeros(len(f), bool)
            used[0] = True
            inner = np.flatnonzero(f >= 0)
            used[2 * inner + 1] = used[2 * inner + 2] = True
            rows += [(t, int(n), int(f[n]), float(c[n]), float(v[n])) for n in np.flatnonzero(used)]
        return spark.createDataFrame(rows, "tree int, node int, feature int, cut double, value double")

    def save(self, spark: SparkSession, path: str) -> None:
        d = self.nodes(spark).withColumn("features", F.lit(self.numFeatures)).withColumn("base", F.lit(self.base))
        d.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Forest:
        rows = defaultdict(list)
        for r in spark.read.parquet(path).collect():  # one model's nodes
            rows[r["tree"]].append(r)
            base, features = r["base"], r["features"]
        trees = []
        for _, part in sorted(rows.items()):
            size = (2 << (max(r["node"] for r in part) + 1).bit_length() - 1) - 1
            f, c, v = np.full(size, -1, np.int16), np.zeros(size), np.zeros(size)
            for r in part:
                f[r["node"]], c[r["node"]], v[r["node"]] = r["feature"], r["cut"], r["value"]
            trees.append((f, c, v))
        return cls(base, trees, features)


def search(binned: Binned, targets: int, grid: Mapping[str, Sequence], num_folds: int) -> list[list[dict]]:
    """Exhaustive grid for each target: its points with ``score`` (mean exact AUC over the folds).

    ``grid`` has the keys ``maxIter``, ``maxDepth`` and ``stepSize``.  All AUCs come from one grouped job.
    """
    depths, steps = list(grid.get("maxDepth", [5])), list(grid.get("stepSize", [0.1]))
    stages = sorted(set(grid.get("maxIter", [20])))
    keys = list(itertools.product(range(targets), depths, steps))
    chains = [Chain(t, f, d, s) for t, d, s in keys for f in range(num_folds)]
    scored: list[DataFrame] = []
    fit(binned, chains, stages, scored=scored)
    means = {}
    if scored:
        auc = roc_auc(reduce(DataFrame.unionByName, scored), "y", "score", ["chain", "trees"])
        auc = auc.groupBy(F.floor(F.col("chain") / num_folds).alias("k"), "trees").agg(F.avg("roc_auc").alias("score"))
        means = {(r["k"], r["trees"]): r["score"] for r in auc.collect()}  # a row a grid point
        release(*scored)
    return [[{"maxDepth": d, "stepSize": s, "maxIter": n, "score": means.get((k, n))}
             for k, (t, d, s) in enumerate(keys) if t == target for n in stages] for target in range(targets)]


def refit(binned: Binned, params: Sequence[Mapping], weighted: bool = False) -> list[Forest]:
    """The chosen point of each target on all its rows, side by side; without class weights unless ``weighted``, as in the
    reference."""
    chains = [Chain(t, -1, p["maxDepth"], p["stepSize"], weighted) for t, p in enumerate(params)]
    most = [p["maxIter"] for p in params]
    return [Forest.of(base, trees[:n], binned.cuts) for (base, trees), n in zip(fit(binned, chains, [max(most)]), most)]


def predict(model: Forest, df: DataFrame, features: str = "features", score: str = "score",
            pred: str = "prediction") -> DataFrame:
    """Positive-class probability, and the label it gives (1 above one half)."""
    @F.pandas_udf("double")
    def probability(x: pd.Series) -> pd.Series:
        return pd.Series(1 / (1 + np.exp(-model.margins(np.stack(x.to_numpy()))))) if len(x) else pd.Series([], dtype=float)

    return df.withColumn(score, probability(_values(df, features))).withColumn(pred, (F.col(score) > 0.5).cast("int"))


def split_count_importance(model: Forest, spark: SparkSession, feature_names: Sequence[str], k: int | None = None) -> DataFrame:
    """Number of splits per feature over all trees ("weight" importance), descending."""
    names = spark.createDataFrame(list(enumerate(feature_names)), "i int, name string")
    n = model.nodes(spark).filter("feature >= 0").groupBy("feature").agg(F.count(F.lit(1)).alias("splits"))
    out = n.join(F.broadcast(names), F.col("feature") == F.col("i")).select(F.col("name").alias("feature"), "splits")
    return top_k(out, "splits", k, ["feature"]) if k else out.orderBy(F.desc("splits"), "feature")
