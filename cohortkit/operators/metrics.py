"""Binary classification metrics, exact and tie-aware, optionally per group
(e.g. per horizon in one pass over a long (group, label, score) frame).

Scores are pre-aggregated to one row per (group, distinct score) first; the
curves then need running sums over descending score (``prefix.running_sums``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortkit.operators.ordered import positions
from cohortkit.operators.prefix import null_safe_join, running_sums


def _by_score(df: DataFrame, label: str, score: str, group: Sequence[str]) -> DataFrame:
    g = list(group)
    # rows without a score or label cannot be ranked
    df = df.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(label).isNotNull())
    per = (df.groupBy(*g, F.col(score).cast("double").alias("threshold"))
           .agg(F.sum((F.col(label) == 1).cast("long")).alias("pos"),
                F.sum((F.col(label) != 1).cast("long")).alias("neg"))
           .persist())  # one row per (group, distinct score); read by every pass below
    cum = running_sums(per, "threshold", ["pos", "neg"], descending=True, partition_by=g)
    tot = per.groupBy(*g).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))  # one row per group
    if not g:  # attach the single totals row
        cum, tot, g = cum.withColumn("_one", F.lit(1)), tot.withColumn("_one", F.lit(1)), ["_one"]
        return cum.join(F.broadcast(tot), g, "left").drop("_one")
    # one row per group: no hint, AQE broadcasts it after measuring its size
    return null_safe_join(cum, tot, g)


def _corners(c: DataFrame, group: Sequence[str], chunk_rows: int) -> DataFrame:
    """Rows of ``c`` whose step differs from the next row's, and each group's first and last.

    A point between two equal steps lies on the line through its neighbours.  Rows are ordered in chunks; the step after a
    chunk's last row is the one of the group's next chunk, taken from one edge row a chunk.
    """
    g, step = list(group), F.struct("pos", "neg")
    n = max(1, -(-c.count() // chunk_rows))
    o = positions(c, [*g, F.desc("threshold")], n)
    edge = o.groupBy(*g, "_chunk").agg(F.min_by(step, "_pos").alias("_edge"))
    edge = edge.select(*g, "_chunk", F.lead("_edge").over(Window.partitionBy(*g).orderBy("_chunk")).alias("_beyond"))
    inside = F.lead(step).over(Window.partitionBy(*g, "_chunk").orderBy("_pos"))
    o = null_safe_join(o.withColumn("_next", inside), edge, [*g, "_chunk"])
    after = F.coalesce("_next", "_beyond")  # NULL after a group's last row
    first = F.col("cum_pos") + F.col("cum_neg") == F.col("pos") + F.col("neg")
    return o.filter(first | after.isNull() | (after != step)).drop("_next", "_beyond", "_pos", "_chunk")


def roc_curve(df: DataFrame, label: str, score: str, group: Sequence[str] = (), drop_intermediate: bool = False,
              start: bool = False, chunk_rows: int = 50_000) -> DataFrame:
    """(group, threshold, fpr, tpr): one point per distinct score, ties grouped; NULL rates without that class.

    ``drop_intermediate`` leaves out points on the line between their neighbours, ``start`` adds the point (0, 0) at threshold
    infinity: with both, the points that the reference's library returns by default.
    """
    c = _by_score(df, label, score, group)
    if drop_intermediate:
        c = _corners(c, group, chunk_rows)
    cols = [*group, "threshold", F.try_divide("cum_neg", "N").alias("fpr"), F.try_divide("cum_pos", "P").alias("tpr")]
    if not start:
        return c.select(*cols)
    # the first row of a group once more, at infinity and with nothing before it
    first = F.col("cum_pos") + F.col("cum_neg") == F.col("pos") + F.col("neg")
    zero = c.filter(first).withColumns({"threshold": F.lit(float("inf")), "cum_neg": F.lit(0), "cum_pos": F.lit(0)})
    return c.select(*cols).unionByName(zero.select(*cols))


def roc_auc(df: DataFrame, label: str, score: str, group: Sequence[str] = ()) -> DataFrame:
    """Exact ROC AUC with ties counted one half (Mann-Whitney); NULL for a group of one class."""
    c = _by_score(df, label, score, group)
    term = F.col("pos") * (F.col("N") - F.col("cum_neg") + 0.5 * F.col("neg"))
    agg = F.try_divide(F.sum(term), F.first("P") * F.first("N")).alias("roc_auc")
    return c.groupBy(*group).agg(agg) if group else c.agg(agg)


def pr_curve(df: DataFrame, label: str, score: str, group: Sequence[str] = ()) -> DataFrame:
    """(group, threshold, precision, recall) per distinct score."""
    c = _by_score(df, label, score, group)
    return c.select(*group, "threshold",
                    (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
                    F.try_divide("cum_pos", "P").alias("recall"))


def average_precision(df: DataFrame, label: str, score: str, group: Sequence[str] = ()) -> DataFrame:
    """Step-wise AP: sum over thresholds of (recall gain) x precision."""
    c = _by_score(df, label, score, group)
    term = F.try_divide("pos", "P") * (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))
    agg = F.sum(term).alias("average_precision")
    return c.groupBy(*group).agg(agg) if group else c.agg(agg)


def _safe_div(a, b):
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def classification_report(df: DataFrame, label: str, pred: str, group: Sequence[str] = ()) -> DataFrame:
    """Per class precision, recall, f1, support; accuracy; macro and weighted means.

    One grouped confusion count, then arithmetic.  Zero divisions give 0.
    The accuracy row carries accuracy in every metric column and the total support.
    """
    g = list(group)
    y = F.col(label).cast("int")
    p = F.col(pred).cast("int")
    cm = df.groupBy(*g).agg(
        F.sum(((y == 1) & (p == 1)).cast("long")).alias("tp"),
        F.sum(((y == 0) & (p == 1)).cast("long")).alias("fp"),
        F.sum(((y == 1) & (p == 0)).cast("long")).alias("fn"),
        F.sum(((y == 0) & (p == 0)).cast("long")).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    per = []
    for cls, t, f, miss in (("0", tn, fn, fp), ("1", tp, fp, fn)):
        prec, rec = _safe_div(t, t + f), _safe_div(t, t + miss)
        per.append((cls, [prec, rec, _safe_div(2 * prec * rec, prec + rec)], t + miss))
    (_, m0, s0), (_, m1, s1) = per
    rows = per + [("accuracy", [_safe_div(tp + tn, n)] * 3, n),
                  ("macro avg", [(a + b) / 2 for a, b in zip(m0, m1)], n),
                  ("weighted avg", [F.try_divide(a * s0 + b * s1, n) for a, b in zip(m0, m1)], n)]
    names = ("precision", "recall", "f1_score")
    out = F.array(*[F.struct(F.lit(c).alias("class"), *[v.alias(m) for v, m in zip(vals, names)], sup.alias("support"))
                    for c, vals, sup in rows])
    return cm.select(*g, F.explode(out).alias("_m")).select(*g, "_m.*")
