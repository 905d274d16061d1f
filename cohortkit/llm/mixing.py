"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Each source gets a target number of words: its weight's share of ``share`` x all
words, at most ``cap`` x its own words, the excess dealt again by weight.  The
expected number of copies of a document is its source's ``target / words``.  The
expected copies are prefix-summed along the source (ordered by size class, then
by a hash of the id), one offset in [0, 1) drawn from the seed is added, and a
document is emitted once for each integer boundary its interval crosses.  As the
expectation is the same for all documents of a source, the prefix sum is
``rank x rate``; walking the sizes in order keeps the words near the target.

The rank needs no window over a source: counts per (source, size class, 1 of 256
hash buckets) are prefix-summed in two short windows, and only a bucket is
numbered row by row.  The per-source table (one row per source) is the only one
that is sorted in one task.

Defined cases: NULL text has size 0; NULL source is a source of its own, last;
NULL ids hash as the word ``null``; rows equal in id and size are interchangeable;
sources without words get target 0 and no copies; an empty table gives no rows;
further columns are carried only when named in ``carry``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortkit.llm.common import WORD
from cohortkit.session import materialize


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """(skey, source_size) -> target and rate per source.

    With sources ordered by cap / weight, the level is the largest
    (total - caps before) / (weights from here on) that does not exceed its own cap / weight.
    """
    by_name = Window.orderBy("skey")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("most", F.col("source_size") * float(cap))
    s = s.withColumn("fill", F.col("most") / F.col("w"))
    every = Window.partitionBy()
    order = Window.orderBy("fill", "skey")
    total = F.sum("source_size").over(every) * float(share)
    before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after_w = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("try", (total - before) / after_w)
    s = s.withColumn("level", F.max(F.when(F.col("try") <= F.col("fill"), F.col("try"))).over(every))
    target = F.least(F.col("most"), F.coalesce(F.col("level") * F.col("w"), F.col("most")))
    return s.select("skey", "source_size", target.alias("target"),
                    F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"))


def systematic_copies(docs: DataFrame, carry: Sequence[str], text_col: str = "text", id_col: str = "doc_id",
                      source_col: str = "source", weights: Sequence[float] = (3, 1, 2), share: float = 1.5,
                      cap: float = 2.0, seed: int = 42) -> DataFrame:
    """One row per document: struct ``doc`` of the carried columns, size, source_size, target, copies."""
    size = word_count(F.col(text_col))
    h = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(f":{seed}")).cast("binary"))
    base = docs.select(
        F.struct(*[F.col(c) for c in carry]).alias("doc"),
        F.col(id_col).alias("id"),
        size.alias("size"),
        F.coalesce(F.concat(F.lit("0"), F.col(source_col)), F.lit("1")).alias("skey"),
        h.alias("h"),
    )
    bits = F.length(F.bin("size"))
    base = base.withColumn("cls", (bits * 8 + F.expr("shiftright(size, greatest(length(bin(size)) - 3, 0))")).cast("int"))
    base = base.withColumn("bucket", F.conv(F.substring("h", 1, 2), 16, 10).cast("int"))
    base = materialize(base, "mix")  # the text is read and counted once

    cells = base.groupBy("skey", "cls", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    cells = materialize(cells, "mix-cells")
    rates = source_targets(cells.groupBy("skey").agg(F.sum("words").alias("source_size")), weights, share, cap)

    up_to = (Window.unboundedPreceding, -1)
    in_class = Window.partitionBy("skey", "cls").orderBy("bucket").rowsBetween(*up_to)
    in_source = Window.partitionBy("skey").orderBy("cls").rowsBetween(*up_to)
    classes = cells.groupBy("skey", "cls").agg(F.sum("n").alias("n"))
    classes = classes.select("skey", "cls", F.coalesce(F.sum("n").over(in_source), F.lit(0)).alias("c0"))
    classes = classes.join(rates, "skey")
    offsets = cells.select("skey", "cls", "bucket", F.coalesce(F.sum("n").over(in_class), F.lit(0)).alias("b0"))
    offsets = offsets.join(classes, ["skey", "cls"])

    j = base.join(offsets, ["skey", "cls", "bucket"])
    row = F.row_number().over(Window.partitionBy("skey", "cls", "bucket").orderBy("h", "id", "size"))
    j = j.withColumn("k", F.col("c0") + F.col("b0") + row)
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("skey")).cast("binary")), 1, 8), 16, 10).cast(
        "double") / F.lit(4294967296.0)
    j = j.withColumn("u", u)
    copies = F.floor(F.col("k") * F.col("rate") + F.col("u")) - F.floor((F.col("k") - 1) * F.col("rate") + F.col("u"))
    return j.select("doc", "size", "source_size", "target",
                    F.least(copies, F.lit(int(cap))).cast("int").alias("copies"))


def mix(docs: DataFrame, **kw) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as it is taken, with its own columns."""
    d = systematic_copies(docs, carry=docs.columns, **kw)
    d = d.filter("copies > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return d.select("doc.*")
