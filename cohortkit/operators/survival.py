"""Survival analysis: Kaplan-Meier, concordance index, Cox proportional hazards.

All three reduce to aggregates over distinct times plus running sums over time
(``prefix.running_sums``); nothing forms pairs of rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortkit.operators.ordered import positions, totals_before
from cohortkit.operators.prefix import bucketize, key_splits, running_sums
from cohortkit.session import release

Z_95 = 1.959963984540054  # two-sided 95 % normal quantile


def survival_window(df: DataFrame, time: str = "survival_time", event: str = "cdiff_survival_flag",
                    lo: float = 0.0, hi: float = 30.0) -> DataFrame:
    """Rows with ``lo < time < hi`` (NULL dropped), event cast to boolean."""
    return (df.filter((F.col(time) > lo) & (F.col(time) < hi))
            .withColumn(event, F.col(event).cast("boolean")))


def as_structured(df: DataFrame, event: str = "cdiff_survival_flag", time: str = "survival_time",
                  name: str = "y") -> DataFrame:
    """Survival target as one struct column (status boolean, survival_in_days double)."""
    return df.withColumn(name, F.struct(F.col(event).cast("boolean").alias("status"),
                                        F.col(time).cast("double").alias("survival_in_days")))


# ---------------------------------------------------------------- Kaplan-Meier
def kaplan_meier(df: DataFrame, time: str, event: str, group: Sequence[str] = (),
                 conf_level_z: float = Z_95) -> DataFrame:
    """Product-limit curve with Greenwood variance and log-log confidence band.

    One row per (group, distinct time): time, n_at_risk, n_events, n_censored,
    survival, ci_lower, ci_upper.
    """
    g = list(group)
    # a row without a time or event says nothing about the curve
    df = df.filter(F.col(time).isNotNull() & ~F.isnan(F.col(time).cast("double")) & F.col(event).isNotNull())
    per = (df.groupBy(*g, F.col(time).cast("double").alias("time"))
           .agg(F.sum(F.col(event).cast("long")).alias("n_events"), F.count(F.lit(1)).alias("_n"))
           .persist())  # one row per distinct time; read by both passes below
    risk = running_sums(per, "time", ["_n"], descending=True, partition_by=g, prefix="risk")
    risk = risk.withColumnRenamed("risk_n", "n_at_risk")
    d = F.col("n_events").cast("double")
    n = F.col("n_at_risk").cast("double")
    terms = risk.withColumns({
        "_log": F.when(n > d, F.log1p(-d / n)).otherwise(F.lit(0.0)),
        "_zero": (n == d).cast("long"),
        "_gw": F.when(n > d, d / (n * (n - d))).otherwise(F.lit(0.0)),
    }).persist()
    cum = running_sums(terms, "time", ["_log", "_zero", "_gw"], partition_by=g, prefix="c")
    s = F.when(F.col("c_zero") > 0, F.lit(0.0)).otherwise(F.exp("c_log"))
    out = cum.withColumn("survival", s)
    eps = np.finfo(float).eps
    logp = F.log(F.col("survival"))
    theta = F.lit(conf_level_z) * F.sqrt("c_gw") / logp
    ok = F.col("survival") > eps
    lower = F.when(~ok, 0.0).when(logp < -eps, F.exp(F.exp(-theta) * logp)).otherwise(F.col("survival"))
    upper = F.when(~ok, 0.0).when(logp < -eps, F.exp(F.exp(theta) * logp)).otherwise(F.col("survival"))
    return out.select(*g, "time", "n_at_risk", "n_events", (F.col("_n") - F.col("n_events")).alias("n_censored"),
                      "survival", lower.alias("ci_lower"), upper.alias("ci_upper"))


# ----------------------------------------------------------- concordance index
def _inversions(order: np.ndarray, key: np.ndarray, n: np.ndarray, ev: np.ndarray) -> float:
    """Sum over i of ev_i times the n_j of all j that come before i in ``order`` and have a larger ``key``.

    Halves of blocks of doubling width: at each width an element of a right half meets the left half of its block, sorted by key.
    """
    o = np.argsort(order, kind="stable")
    rank = np.unique(key, return_inverse=True)[1][o].astype(np.int64)
    n, ev = n[o], ev[o]
    at, ranks = np.arange(len(o)), int(rank.max(initial=0)) + 1
    total, width = 0.0, 1
    while width < len(o):
        left = at // width % 2 == 0
        block = at // (2 * width)
        # larger keys first; of equal keys the right half's, which count no equal ones
        x = np.argsort(block * (2 * ranks) + (ranks - 1 - rank) * 2 + left)
        seen = np.cumsum(np.where(left[x], n[x], 0))
        start = np.searchsorted(block[x], block[x])
        before = np.concatenate([[0], seen])[start]
        right = ~left[x]
        total += float((ev[x][right].astype(float) * (seen - before)[right]).sum())
        width *= 2
    return total


def _sweep(name: str, key: str):
    """applyInPandas body: ``_inversions`` of one chunk's rows, ordered by score and compared by ``key``."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cols = [pdf[c].to_numpy().astype(np.int64) for c in ("_q", key, "_n", "_ev")]
        return pd.DataFrame({"what": [name], "v": [_inversions(*cols)]})

    return run


def concordance_index(df: DataFrame, time: str, event: str, score: str,
                      n_chunks: int | None = None, chunk_rows: int = 50_000) -> DataFrame:
    """Harrell's C for right-censored data (higher score = earlier event).

    A pair (i, j) is comparable when i is an event and T_j > T_i, or T_j == T_i
    with j censored; concordant when S_i > S_j, a score tie counts one half.
    One row: cindex, concordant, discordant, tied_risk, comparable.

    Nothing forms pairs.  Rows are reduced to distinct (time, censored, score) with counts and get two unique positions: in
    order of (time, censored, score), and in order of (score, first position).  A pair is concordant exactly if the partner's first
    position is higher and its second lower, so ties need no care, and one time or score may span any number of chunks.
    With chunks of both orders (at most as many cells as rows) the dominance counts are

    * partners in later chunks of the first order and earlier chunks of the second: prefix sums of the grid of counts,
      along both axes, by windows;
    * partners in the same chunk of the first order, and partners in the same chunk of the second but later
      chunks of the first: inversions of one chunk at a time.

    Comparable and tied pairs are sums of counts inside chunks and over later chunks.
    """
    spark = df.sparkSession
    base = (df.select(F.col(time).cast("double").alias("_t"), F.col(score).cast("double").alias("_s"),
                      F.col(event).cast("int").alias("_e"))
            .filter(F.col("_t").isNotNull() & F.col("_s").isNotNull() & F.col("_e").isNotNull()
                    & ~F.isnan("_t") & ~F.isnan("_s")))
    ts = base.groupBy("_t", F.when(F.col("_e") == 0, 1).otherwise(0).alias("_c"), "_s").agg(F.count(F.lit(1)).alias("_n"))
    ts = ts.withColumn("_ev", F.when(F.col("_c") == 0, F.col("_n")).otherwise(0)).persist()
    rows = ts.count()  # also fills the cache
    k = n_chunks or max(1, -(-rows // max(chunk_rows, math.isqrt(rows))))
    first = positions(ts, ["_t", "_c", "_s"], k, "_p", "_a")
    ts.unpersist()
    both = positions(first, ["_s", "_p"], k, "_q", "_b", frees=(first,))

    def total(name, frame, expr):
        return frame.agg(F.coalesce(F.sum(expr.cast("double")), F.lit(0.0)).alias("v")).select(F.lit(name).alias("what"), "v")

    def rest(*by, order):
        return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)

    def summed(c, w):
        return F.coalesce(F.sum(c).over(w), F.lit(0))

    ev = F.col("_ev")
    # comparable: counts of larger (time, censored) in the chunk and in later chunks, where the same one may go on
    u = both.groupBy("_a", "_t", "_c").agg(F.sum("_n").alias("_n"), F.sum("_ev").alias("_ev"))
    later = totals_before(both.groupBy("_a").agg(F.sum("_n").alias("_n")), "_a", ["_n"], after=True)
    u = u.withColumn("_in", summed("_n", rest("_a", order=[F.desc("_t"), F.desc("_c")]))).join(later, "_a")
    u = u.withColumn("_same", summed("_n", rest("_t", "_c", order=[F.desc("_a")])))
    parts = [total("comparable", u, ev * (F.col("_in") + F.col("_o__n") - F.col("_same")))]
    # tied: the same score at larger (time, censored), in the chunk and in later ones
    inside = both.withColumn("_later", summed("_n", rest("_b", "_s", order=[F.desc("_q")])))
    parts.append(total("tied", inside, ev * F.col("_later")))
    s = both.groupBy("_b", "_s").agg(F.sum("_n").alias("_n"), F.sum("_ev").alias("_ev"))
    parts.append(total("tied", s.withColumn("_later", summed("_n", rest("_s", order=[F.desc("_b")]))), ev * F.col("_later")))
    sweep = both.select("_a", "_b", "_p", "_q", "_n", "_ev")
    parts.append(sweep.groupBy("_a").applyInPandas(_sweep("concordant", "_p"), "what string, v double"))
    if k > 1:
        parts.append(sweep.groupBy("_b").applyInPandas(_sweep("concordant", "_a"), "what string, v double"))
        counts = both.groupBy("_a", "_b").agg(F.sum("_n").alias("_n"), F.sum("_ev").alias("_ev"))
        grid = spark.range(k * k).select(F.expr(f"id div {k}").alias("_a"), (F.col("id") % k).alias("_b"))
        grid = grid.join(counts, ["_a", "_b"], "left")
        grid = grid.withColumn("_col", summed("_n", rest("_b", order=[F.desc("_a")])))
        grid = grid.withColumn("_low", summed("_col", rest("_a", order=[F.asc("_b")])))
        parts.append(total("concordant", grid, ev * F.col("_low")))
    sums = reduce(DataFrame.unionByName, parts).groupBy("what").agg(F.sum("v").alias("v")).collect()  # three rows
    release(both)
    v = {r["what"]: r["v"] for r in sums}
    den, concordant, tied = (v.get(x, 0.0) for x in ("comparable", "concordant", "tied"))
    cindex = (concordant + 0.5 * tied) / den if den else None
    return spark.createDataFrame(
        [(cindex, concordant, den - concordant - tied, tied, den)],
        "cindex double, concordant double, discordant double, tied_risk double, comparable double")


# ------------------------------------------------------------------------- Cox
def _cox_totals(feats, beta, shift):
    """mapInPandas body: sums of w, w x, w x x' of each time bucket met in a task."""

    def run(batches):
        tot = {}
        for pdf in batches:
            for b, rows in pdf.groupby("_b"):
                X = rows[feats].to_numpy(dtype="float64")
                w = np.exp(X @ beta - shift)
                old = tot.get(b, (0.0, 0.0, 0.0))
                tot[b] = (old[0] + w.sum(), old[1] + w @ X, old[2] + X.T @ (X * w[:, None]))
        for b, (r0, r1, r2) in tot.items():
            yield pd.DataFrame({"_b": [b], "r0": [r0], "r1": [r1], "r2": [r2.ravel()]})

    return run


class _CoxSums:
    """Log-likelihood, gradient and Hessian of rows that arrive by bucket, latest time first."""

    def __init__(self, p: int):
        self.ll, self.grad, self.hess = 0.0, np.zeros(p), np.zeros((p, p))
        self.bucket = None
        self.open(None, (0.0, np.zeros(p), np.zeros((p, p))))

    def open(self, bucket, later) -> None:
        """Start a bucket; ``later`` holds the risk sums of all later buckets."""
        self.close_time()
        self.bucket, self.time = bucket, None
        self.s0, self.s1, self.s2 = later

    def close_time(self) -> None:
        """Count the events of the current time, whose rows are all in the risk sums now."""
        if self.bucket is not None and self.d > 0:
            mu = self.s1 / self.s0
            self.ll += self.ee - self.d * np.log(self.s0)
            self.grad += self.ex - self.d * mu
            self.hess += self.d * (self.s2 / self.s0 - np.outer(mu, mu))
        self.d, self.ex, self.ee = 0.0, np.zeros(len(self.grad)), 0.0

    def add(self, t: np.ndarray, X: np.ndarray, e: np.ndarray, eta: np.ndarray) -> None:
        """Rows of one bucket in order; the last time stays open, as its rows may go on."""
        if t[0] != self.time:
            self.close_time()
        w = np.exp(eta)
        at = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        of = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(t)]))
        c0 = self.s0 + np.cumsum(np.add.reduceat(w, at))
        c1 = self.s1 + np.cumsum(np.add.reduceat(w[:, None] * X, at, axis=0), axis=0)
        d, ex, ee = np.add.reduceat(e, at), np.add.reduceat(e[:, None] * X, at, axis=0), np.add.reduceat(e * eta, at)
        d[0], ex[0], ee[0] = d[0] + self.d, ex[0] + self.ex, ee[0] + self.ee
        self.time, self.d, self.ex, self.ee = t[-1], d[-1], ex[-1], ee[-1]
        done = d.copy()
        done[-1] = 0
        k = done > 0
        mu = c1[k] / c0[k][:, None]
        self.ll += float(np.sum(ee[k] - d[k] * np.log(c0[k])))
        self.grad += (ex[k] - d[k][:, None] * mu).sum(axis=0)
        # sum over times of d S2 / S0, with the sums swapped: each row counts for its own and all earlier times
        rate = done / c0
        reach = np.cumsum(rate[::-1])[::-1]
        self.hess += self.s2 * rate.sum() + X.T @ (X * (w * reach[of])[:, None]) - mu.T @ (mu * d[k][:, None])
        self.s0, self.s1, self.s2 = c0[-1], c1[-1], self.s2 + X.T @ (X * w[:, None])


def _cox_terms(feats, beta, shift, offsets):
    """mapInPandas body: a task's share of log-likelihood, gradient and Hessian, in one row."""

    def run(batches):
        sums = _CoxSums(len(feats))
        for pdf in batches:
            for b, rows in pdf.groupby("_b", sort=False):
                if b != sums.bucket:
                    sums.open(b, offsets[b])
                X = rows[feats].to_numpy(dtype="float64")
                sums.add(rows["_t"].to_numpy(dtype="float64"), X, rows["_e"].to_numpy(dtype="float64"), X @ beta - shift)
        sums.close_time()
        yield pd.DataFrame({"ll": [sums.ll], "g": [sums.grad], "h": [sums.hess.ravel()]})

    return run


def _independent(hess: np.ndarray, tol: float = 1e-9) -> list[int]:
    """Features, in order, that are no linear combination of those kept before (Cholesky pivots)."""
    keep: list[int] = []
    for i in range(len(hess)):
        rest = hess[i, i]
        if keep:
            rest -= hess[i, keep] @ np.linalg.solve(hess[np.ix_(keep, keep)], hess[keep, i])
        if rest > tol * hess[i, i] and hess[i, i] > 0:
            keep.append(i)
    return keep


def fit_cox(df: DataFrame, features: Sequence[str], time: str, event: str, max_iter: int = 100,
            tol: float = 1e-9, standardize: bool = False, n_buckets: int | None = None) -> dict:
    """Cox proportional hazards, Breslow ties, no penalty, Newton-Raphson with step halving.

    The rows are dealt by time bucket and sorted once; no iteration shuffles.  Per iteration one pass sums
    w, w x, w x x' (w = exp(x.b)) per bucket, and one streams each bucket from its latest time down with running
    sums that start at those of the later buckets; bucket totals and one row per task reach the driver.
    The p x p Newton system is solved there.  Features that others determine within the risk sets
    (one-hots that sum to one, constants) keep coefficient 0 and are listed in ``aliased``.
    Rows with a missing feature, time or event take no part; ``n_dropped`` counts them.
    Returns {features, coef, loglik, n_iter, scale, n_rows, n_dropped, aliased}.
    """
    from cohortkit.operators.prep import standardise, standardise_stats

    feats = list(features)
    scale = None
    spark = df.sparkSession
    # the selected rows are cached once; scaling, counting and every Newton pass read the cache
    cached = df.select(*[F.col(c).cast("double") for c in feats], F.col(time).cast("double").alias("_t"),
                       F.col(event).cast("int").alias("_e")).persist()
    n_all = cached.count()
    base = cached.dropna()
    n_rows = base.count()
    data = base
    if standardize:
        scale = standardise_stats(base, feats)
        data = standardise(base, feats, scale)
    if n_buckets is None:  # ~200k rows per time bucket, at most one bucket per shuffle partition
        n_buckets = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // 200_000)))
    # fixed for every iteration; one bucket needs no split points (no quantile job)
    splits = key_splits(data, "_t", n_buckets) if n_buckets > 1 else [float("-inf"), float("inf")]
    p = len(feats)
    nb = len(splits) - 1
    data = (bucketize(data, "_t", splits, "_b").withColumn("_b", F.col("_b").cast("int")).repartition(nb, "_b")
            .sortWithinPartitions("_b", F.desc("_t")).persist())

    ends = data.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(feats) for n, f in (("lo", F.min), ("hi", F.max))]
                    ).first() if p and n_rows else None

    def shift_of(beta):
        """0 while no weight can overflow, else the largest linear predictor."""
        if ends is None or sum(max(b * ends[f"lo{i}"], b * ends[f"hi{i}"]) for i, b in enumerate(beta)) < 600:
            return 0.0
        return data.agg(F.max(sum(F.col(c) * F.lit(float(b)) for c, b in zip(feats, beta)))).first()[0]

    def evaluate(beta):
        beta = np.asarray(beta, dtype="float64")
        shift = shift_of(beta)
        tot = {r["_b"]: (r["r0"], np.asarray(r["r1"]), np.asarray(r["r2"]).reshape(p, p)) for r in
               data.mapInPandas(_cox_totals(feats, beta, shift), "_b int, r0 double, r1 array<double>, r2 array<double>")
               .collect()} if nb > 1 else {0: None}  # one row per bucket
        offsets, acc = {}, (0.0, np.zeros(p), np.zeros((p, p)))
        for b in sorted(tot, reverse=True):  # later buckets first
            offsets[b] = acc
            if nb > 1:
                acc = tuple(x + y for x, y in zip(acc, tot[b]))
        parts = data.mapInPandas(_cox_terms(feats, beta, shift, offsets),
                                 "ll double, g array<double>, h array<double>").collect()  # one row per task
        ll = sum(r["ll"] for r in parts)
        grad = np.sum([np.asarray(r["g"]) for r in parts], axis=0) if parts else np.zeros(p)
        hess = (np.sum([np.asarray(r["h"]) for r in parts], axis=0) if parts else np.zeros(p * p)).reshape(p, p)
        return ll, grad, hess

    beta = np.zeros(p)
    try:
        ll, grad, hess = evaluate(beta)
        keep = _independent(hess)
        it = 0
        for it in range(1, max_iter + 1):
            step = np.zeros(p)
            step[keep] = np.linalg.solve(hess[np.ix_(keep, keep)], grad[keep])
            t = 1.0
            while True:
                nb_ = beta + t * step
                nll, ng, nh = evaluate(nb_)
                if nll >= ll - 1e-12 or t < 1e-6:
                    break
                t *= 0.5
            done = abs(nll - ll) <= tol * (abs(ll) + tol) or np.max(np.abs(nb_ - beta), initial=0.0) < tol
            beta, ll, grad, hess = nb_, nll, ng, nh
            if done:
                break
    finally:
        data.unpersist()
        cached.unpersist()
    return {"features": feats, "coef": [float(x) for x in beta], "loglik": float(ll), "n_iter": it,
            "scale": scale, "n_rows": n_rows, "n_dropped": n_all - n_rows,
            "aliased": [f for i, f in enumerate(feats) if i not in keep]}


def cox_predict(model: dict, df: DataFrame, name: str = "risk_score") -> DataFrame:
    """Linear predictor x.b (after the model's scaling, if any)."""
    feats = model["features"]
    sc = model.get("scale")
    terms = []
    for c, b in zip(feats, model["coef"]):
        x = F.col(c).cast("double")
        if sc:
            m, s = sc[c]
            x = (x - F.lit(m)) / F.lit(s if s else 1.0)
        terms.append(x * F.lit(b))
    return df.withColumn(name, sum(terms) if terms else F.lit(0.0))


def hazard_ratios(spark, model: dict) -> DataFrame:
    """(feature, coef, hazard_ratio) ordered by hazard ratio descending."""
    rows = list(zip(model["features"], model["coef"]))
    return (spark.createDataFrame(rows, T.StructType([T.StructField("feature", T.StringType()),
                                                      T.StructField("coef", T.DoubleType())]))
            .withColumn("hazard_ratio", F.exp("coef")).orderBy(F.desc("hazard_ratio"), "feature"))


def save_cox(spark, model: dict, path: str) -> None:
    """Coefficients (and scaling) as a small Parquet table."""
    sc = model.get("scale") or {}
    rows = [(f, c, (sc.get(f) or (None, None))[0], (sc.get(f) or (None, None))[1]) for f, c in
            zip(model["features"], model["coef"])]
    spark.createDataFrame(rows, "feature string, coef double, mean double, sd double") \
        .coalesce(1).write.mode("overwrite").parquet(path)


def load_cox(spark, path: str) -> dict:
    rows = spark.read.parquet(path).collect()  # one row per feature
    scale = {r["feature"]: (r["mean"], r["sd"]) for r in rows if r["mean"] is not None}
    return {"features": [r["feature"] for r in rows], "coef": [r["coef"] for r in rows],
            "scale": scale or None}
