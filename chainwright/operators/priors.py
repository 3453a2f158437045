"""Empirical histogram priors and their lookup."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KERNEL = (1, 2, 3, 4, 3, 2, 1)  # fixed smoothing taps


def histogram_prior(df: DataFrame, value: str, lo: float, hi: float, bins: int, periodic: bool, by: Sequence[str]) -> DataFrame:
    """Smoothed probability and offset negative log likelihood per bin of each context.

    Values become bin counts map-side; only ``bins`` numbers per context go on.
    """
    by = list(by)
    inside = df.where(F.col(value).between(lo, hi))
    number = F.least(F.floor((F.col(value) - lo) / (hi - lo) * bins), F.lit(bins - 1))
    counts = inside.groupBy(*by, number.alias("bin")).agg(F.count(F.lit(1)).alias("_n"))
    table = counts.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("bin", "_n"))).alias("_m"))
    raw = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.element_at("_m", b.cast("long")), F.lit(0)) + 1.0)
    table = table.withColumn("_c", raw)

    def tap(b: Column, k: int) -> Column:
        at = b + (k - 3)
        at = F.pmod(at, F.lit(bins)) if periodic else F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1))
        return F.get("_c", at) * (KERNEL[k] / sum(KERNEL))

    smooth = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: sum((tap(b, k) for k in range(7)), F.lit(0.0)))
    table = table.withColumn("_s", smooth)
    total = F.aggregate("_s", F.lit(0.0), lambda s, x: s + x)
    table = table.withColumn("_p", F.transform("_s", lambda x: x / total))
    table = table.withColumn("_l", F.transform("_p", lambda p: -F.log(F.greatest(p, F.lit(1e-12)))))
    shown = F.posexplode(F.arrays_zip(F.col("_p").alias("p"), F.transform("_l", lambda v: v - F.array_min("_l")).alias("l")))
    spec = [F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(bins).alias("bins"), F.lit(periodic).alias("periodic")]
    return table.select(*by, shown.alias("bin", "_z")).select(*by, "bin", F.col("_z.p").alias("probability"), F.col("_z.l").alias("nll"), *spec)


def with_contexts(df: DataFrame, paired: Column) -> DataFrame:
    """Each row under 'global' and under its pairing context."""
    return df.withColumn("context", F.explode(F.array(F.lit("global"), F.when(paired, "pair_like").otherwise("unpaired"))))


def nll_lookup(df: DataFrame, value: str, context: str, prior: DataFrame, name: str) -> DataFrame:
    """Piecewise-linear lookup between bin centres, periodic or clamped; NULL values stay NULL.

    The prior has contexts x bins rows, so the adaptive planner broadcasts it by measured size.
    """
    spec = prior.groupBy("context").agg(F.max("lo").alias("_lo"), F.max("hi").alias("_hi"), F.max("bins").alias("_bins"), F.bool_or("periodic").alias("_per"))
    left = prior.select(F.col("context"), F.col("bin").alias("_b"), F.col("nll").alias("_left"))
    # Each bin also knows its right neighbour, so one join serves both ends.
    nxt = F.when(F.col("periodic"), F.pmod(F.col("bin") - 1, F.col("bins"))).otherwise(F.col("bin") - 1)
    right = prior.select(F.col("context"), nxt.alias("_b"), F.col("nll").alias("_right"))
    both = left.join(right, ["context", "_b"], "left").withColumn("_right", F.coalesce("_right", "_left")).join(spec, "context")
    grid = both.groupBy("context", "_lo", "_hi", "_bins", "_per").agg(F.array_sort(F.collect_list(F.struct("_b", "_left", "_right"))).alias("_grid"))
    joined = df.join(grid.withColumnRenamed("context", context), context, "left")
    place = (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.col("_bins") - 0.5
    wrapped = place - F.floor(place / F.col("_bins")) * F.col("_bins")
    at = F.when(F.col("_per"), wrapped).otherwise(F.least(F.greatest(place, F.lit(0.0)), F.col("_bins") - 1.0))
    joined = joined.withColumn("_at", at).withColumn("_cell", F.get("_grid", F.floor("_at").cast("int")))
    part = F.col("_at") - F.floor("_at")
    score = (1 - part) * F.col("_cell._left") + part * F.col("_cell._right")
    return joined.withColumn(name, score).select(*df.columns, name)


def pair_to_residue(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean of the row mean and column mean of a pair matrix per position, clipped to [0, 1].

    Each value is sent to both ends, so one aggregation replaces two and their join.
    """
    ends = F.explode(F.array(F.struct(F.col("i").alias("pos"), F.lit(True).alias("row")), F.struct(F.col("j").alias("pos"), F.lit(False).alias("row"))))
    sides = pairs.select(*keys, "value", ends.alias("_e")).select(*keys, "value", "_e.pos", "_e.row")
    means = sides.groupBy(*keys, "pos").agg(F.avg(F.when(F.col("row"), F.col("value"))).alias("_r"), F.avg(F.when(~F.col("row"), F.col("value"))).alias("_c"))
    both = (F.coalesce("_r", "_c") + F.coalesce("_c", "_r")) / 2
    return means.select(*keys, "pos", F.least(F.greatest(both, F.lit(0.0)), F.lit(1.0)).alias("confidence"))


TAU = 2 * math.pi
