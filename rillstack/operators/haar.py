"""Haar-Fisz transform of signals (sig, t, v): differences of pairs over the root of their mean, level by level. A cell of level k covers
2**k samples, so a sample's cell is found by halving its t; an unpaired last cell goes up as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstack.functions.shared import cut


def pyramid(signals: DataFrame, fisz: bool) -> tuple[DataFrame, int]:
    """(sig, level, i, d, paired) of all levels with the mean that is left as level + 1 (in d), and the number of levels."""
    n = signals.agg(F.max("t") + 1).first()[0] or 0
    cells, out, level = signals.select("sig", F.col("t").alias("i"), "v"), None, 0
    while n > 1:
        n, level = n - n // 2, level + 1
        even = F.col("i") % 2 == 0
        p = cells.groupBy("sig", F.floor(F.col("i") / 2).alias("i")).agg(F.max(F.when(even, F.col("v"))).alias("a"), F.max(F.when(~even, F.col("v"))).alias("b"))
        p = p.withColumn("s", F.coalesce((F.col("a") + F.col("b")) / 2, "a")).withColumn("d", F.coalesce((F.col("a") - F.col("b")) / 2, F.lit(0.0)))
        d = F.when(F.col("s") > 0, F.col("d") / F.sqrt("s")).otherwise(0.0) if fisz else F.col("d")
        one = p.select("sig", F.lit(level).alias("level"), "i", d.alias("d"), F.col("b").isNotNull().alias("paired"))
        out = one if out is None else out.union(one)
        cells = p.select("sig", "i", F.col("s").alias("v"))
    top = cells.select("sig", F.lit(level + 1).alias("level"), "i", F.col("v").alias("d"), F.lit(False).alias("paired"))
    return cut(top if out is None else out.union(top)), level


def haar_fisz(signals: DataFrame) -> DataFrame:
    """sig, t, v: variance-stabilised samples (negative ones count as 0): the last mean plus or minus the scaled differences of a sample's cells."""
    own = signals.select("sig", "t", F.greatest("v", F.lit(0.0)).alias("v"))
    cells, levels = pyramid(own, fisz=True)
    at = own.select("sig", "t", F.explode(F.sequence(F.lit(1), F.lit(levels + 1))).alias("level"))
    at = at.withColumn("i", F.when(F.col("level") <= levels, F.expr("shiftright(t, level)")).otherwise(F.lit(0).cast("long")))
    odd = (F.col("level") <= levels) & (F.expr("shiftright(t, level - 1)") % 2 == 1)
    return at.join(cells, ["sig", "level", "i"]).groupBy("sig", "t").agg(F.sum(F.when(odd, -F.col("d")).otherwise(F.col("d"))).alias("v"))


def haar_fisz_inverse(signals: DataFrame) -> DataFrame:
    """sig, t, v: the samples back, from the last mean down; each level's differences are scaled by the root of the mean above them."""
    cells, levels = pyramid(signals, fisz=False)
    now = cells.where(F.col("level") == levels + 1).select("sig", "i", F.col("d").alias("v"))
    for level in range(levels, 0, -1):
        d = F.col("d") * F.sqrt(F.greatest("v", F.lit(0.0)))
        both = F.array(F.struct((2 * F.col("i")).alias("i"), (F.col("v") + d).alias("v")), F.struct((2 * F.col("i") + 1).alias("i"), (F.col("v") - d).alias("v")))
        alone = F.array(F.struct((2 * F.col("i")).alias("i"), F.col("v").alias("v")))
        pair = cells.where(F.col("level") == level).select("sig", "i", "d", "paired")
        now = now.join(pair, ["sig", "i"]).select("sig", F.explode(F.when(F.col("paired"), both).otherwise(alone)).alias("c")).select("sig", "c.i", "c.v")
    return now.select("sig", F.col("i").alias("t"), "v")
