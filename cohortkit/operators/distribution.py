"""Distribution summaries: the data under histograms and density plots."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortkit.operators.prefix import null_safe_join
from cohortkit.operators.quantiles import quantiles_by


def histogram(df: DataFrame, c: str, lo: float, hi: float, bins: int, group: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins over [lo, hi] (the top edge belongs to the last bin);
    counts per (group, bin).  Values outside are dropped."""
    x = F.col(c).cast("double")
    width = (hi - lo) / bins
    b = F.least(F.floor((x - F.lit(lo)) / F.lit(width)).cast("int"), F.lit(bins - 1))
    return (df.filter(x.isNotNull() & (x >= lo) & (x <= hi))
            .groupBy(*group, b.alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"))
            .withColumn("bin_lo", F.lit(lo) + F.col("bin") * F.lit(width))
            .withColumn("bin_hi", F.lit(lo) + (F.col("bin") + 1) * F.lit(width)))


def bw_nrd0(n: int, sd: float, iqr: float) -> float:
    """R's default bandwidth rule: 0.9 min(sd, IQR/1.34) n^-1/5."""
    lo = min(sd, iqr / 1.34) if iqr > 0 else sd
    if not lo:
        lo = sd or abs(iqr) or 1.0
    return 0.9 * lo * n ** -0.2


def _bandwidth(n: Column, sd: Column, iqr: Column) -> Column:
    """``bw_nrd0`` as a column."""
    lo = F.when(iqr > 0, F.least(sd, iqr / 1.34)).otherwise(sd)
    some = F.when(lo != 0, lo).when(sd != 0, sd).when(iqr != 0, F.abs(iqr)).otherwise(F.lit(1.0))
    return 0.9 * some * F.pow(n.cast("double"), F.lit(-0.2))


def kde(df: DataFrame, c: str, group: str | None = None, grid_points: int = 512, cut: float = 3.0,
        log10: bool = False, floor: float | None = None) -> DataFrame:
    """Gaussian density on a grid per group, as R's ``density`` does it: values are linearly binned onto the grid (a
    grouped aggregate, so at most ``grid_points`` rows a group move), then each bin's weight goes to every grid point with
    the kernel's value at their distance and is summed there.

    Everything is columns of one row a group: the bandwidth is R's nrd0 rule from exact sd and IQR, the grid reaches ``cut``
    bandwidths beyond the values.  ``floor`` raises smaller values to it first; without it ``log10`` has no value for zero and
    less, and such rows are left out.  NULL is a group.
    """
    v = F.col(c).cast("double")
    v = v if floor is None else F.when(v.isNotNull(), F.greatest(v, F.lit(float(floor))))
    x = F.log10(v) if log10 else v
    base = df.select(*([F.col(group).cast("string").alias("_g")] if group else [F.lit("all").alias("_g")]),
                     x.alias("_x")).filter(F.col("_x").isNotNull() & ~F.isnan("_x"))
    st = base.groupBy("_g").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.stddev_samp("_x"), F.lit(0.0)).alias("sd"),
                                F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    st = null_safe_join(st, quantiles_by(base, ["_g"], "_x", [0.25, 0.75]), ["_g"])
    st = st.withColumn("bw", _bandwidth(F.col("n"), F.col("sd"), F.col("_q")[1] - F.col("_q")[0]))
    st = st.select("_g", "n", "bw", (F.col("lo") - cut * F.col("bw")).alias("glo"), (F.col("hi") + cut * F.col("bw")).alias("ghi"))
    st = st.withColumn("step", (F.col("ghi") - F.col("glo")) / F.lit(grid_points - 1))
    pos = (F.col("_x") - F.col("glo")) / F.col("step")
    i0 = F.floor(pos).cast("int")
    binned = (null_safe_join(base, st, ["_g"])
              .select("_g", F.explode(F.array(F.struct(i0.alias("i"), (1 - (pos - i0)).alias("w")),
                                              F.struct((i0 + 1).alias("i"), (pos - i0).alias("w")))).alias("_p"))
              .groupBy("_g", F.col("_p.i").alias("i")).agg(F.sum("_p.w").alias("w"))
              .filter(F.col("i").between(0, grid_points - 1)))
    spread = null_safe_join(binned, st, ["_g"]).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(grid_points - 1))))
    far = (F.col("j") - F.col("i")) * F.col("step") / F.col("bw")
    d = spread.groupBy("_g", "j", "glo", "step", "n", "bw").agg(F.sum(F.col("w") * F.exp(-0.5 * far * far)).alias("s"))
    return d.select(F.col("_g").alias("group"), (F.col("glo") + F.col("j") * F.col("step")).alias("x"),
                    (F.col("s") / (F.col("n") * F.col("bw") * F.lit(math.sqrt(2 * math.pi)))).alias("density")).orderBy("group", "x")
