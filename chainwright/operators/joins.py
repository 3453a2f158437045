"""Gated, keyed, spatial and allocation joins."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainwright.functions.sequence import date_gate, length_gate
from chainwright.operators.order import positions

# Widest admissible length ratio is 1 / (1 - 0.6); the bucket is a little wider,
# so two lengths that pass the gate are never more than one bucket apart.
_LENGTH_BASE = math.log(2.6)


def length_bucket(length: Column) -> Column:
    return F.floor(F.log(F.greatest(length.cast("double"), F.lit(1.0))) / _LENGTH_BASE)


def length_pairs(queries: DataFrame, library: DataFrame) -> DataFrame:
    """Query x library rows of admissible relative length.

    The join is an equi-join on a logarithmic length bucket (three per query); a
    skewed bucket is split by the adaptive planner.
    """
    q = queries.withColumn(
        "_bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda s: length_bucket(F.col("q_length")) + s))
    )
    lib = library.withColumn("_bucket", length_bucket(F.col("length")))
    return lib.join(q, "_bucket").where(length_gate(F.col("q_length"), F.col("length"))).drop("_bucket")


def gated_pairs(queries: DataFrame, library: DataFrame) -> DataFrame:
    """Query x library rows that pass the date, self and length gates.

    ``queries``: query, cutoff, own, q_length.  ``library``: entry, released, family,
    length, and anything else.
    """
    return (
        length_pairs(queries, library)
        .where(date_gate(F.col("released"), F.col("cutoff")))
        .where(F.col("family") != F.col("own"))
    )


def leakage_regimes(pairs: DataFrame, query: str, score: str, dated: Column, other: Column) -> DataFrame:
    """Mean best score with all gates, without the date gate, and without any, in one pass."""
    best = pairs.groupBy(query).agg(
        F.max(F.when(dated & other, F.col(score))).alias("_safe"),
        F.max(F.when(other, F.col(score))).alias("_no_date"),
        F.max(score).alias("_oracle"),
    )
    return best.agg(
        F.avg("_safe").alias("safe"),
        F.avg("_no_date").alias("no_date"),
        F.avg("_oracle").alias("oracle"),
        (F.avg("_no_date") - F.avg("_safe")).alias("date_leak"),
        (F.avg("_oracle") - F.avg("_safe")).alias("full_leak"),
        F.count(F.lit(1)).alias("targets"),
    )


def join_1to1(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join that fails the job when either side repeats a key."""
    keys = list(keys)

    def unique(df: DataFrame, name: str) -> DataFrame:
        rest = [c for c in df.columns if c not in keys]
        grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.any_value(F.struct(*rest)).alias("_r"))
        checked = F.when(F.col("_n") > 1, F.raise_error(F.lit(f"{name} side of a one-to-one join repeats a key"))).otherwise(F.col("_r"))
        return grouped.select(*keys, checked.alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in rest])

    return unique(a, "left").join(unique(b, "right"), keys, "left")


def extend_by_key(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``a`` plus the rows of ``b`` whose key ``a`` does not hold."""
    return a.unionByName(b.join(a.select(*keys), list(keys), "left_anti"))


def pair_settings(df: DataFrame, keys: Sequence[str], setting: str, a: str, b: str, values: Sequence[str]) -> DataFrame:
    """Settings a and b side by side on shared keys, in one aggregation instead of a self-join."""
    is_a, is_b = F.col(setting) == a, F.col(setting) == b
    sides = [F.max(F.when(side, F.col(v))).alias(f"{v}_{suffix}") for v in values for side, suffix in ((is_a, "a"), (is_b, "b"))]
    return (
        df.where(F.col(setting).isin(a, b))
        .groupBy(*keys)
        .agg(F.count_if(is_a).alias("_a"), F.count_if(is_b).alias("_b"), *sides)
        .where((F.col("_a") > 0) & (F.col("_b") > 0))
        .drop("_a", "_b")
    )


def radius_pairs(
    left: DataFrame, right: DataFrame, keys: Sequence[str], radius: float, min_separation: int = 1, ordered: bool = True,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Pairs of resolved points of one group within ``radius`` (inclusive), with their distance.

    Both sides carry keys, pos, x, y, z.  Points are hashed to cubes of the radius'
    size and joined on (keys, cube) with the 27 surrounding cubes, so the work
    follows the number of near pairs and one large group spreads over its cubes.
    ``ordered`` keeps i < j only; ``carry`` columns return as ``<name>_i``, ``<name>_j``.
    """
    keys = list(keys)
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    steps = F.array(*[F.struct(*[F.lit(v).cast("long").alias(n) for v, n in zip((a, b, c), "abc")]) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)])
    resolved = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()
    i_side = left.where(resolved).select(
        *keys, F.col("pos").alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi"), F.col("z").alias("zi"), *[F.col(c).alias(f"{c}_i") for c in carry],
        F.explode(F.transform(steps, lambda s: F.struct((cell("x") + s.a).alias("cx"), (cell("y") + s.b).alias("cy"), (cell("z") + s.c).alias("cz")))).alias("_c"),
    ).select("*", "_c.cx", "_c.cy", "_c.cz").drop("_c")
    j_side = right.where(resolved).select(
        *keys, F.col("pos").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"), F.col("z").alias("zj"), *[F.col(c).alias(f"{c}_j") for c in carry],
        cell("x").alias("cx"), cell("y").alias("cy"), cell("z").alias("cz"),
    )
    distance = F.sqrt(
        (F.col("xi") - F.col("xj")) * (F.col("xi") - F.col("xj"))
        + (F.col("yi") - F.col("yj")) * (F.col("yi") - F.col("yj"))
        + (F.col("zi") - F.col("zj")) * (F.col("zi") - F.col("zj"))
    )
    apart = (F.col("j") - F.col("i") >= min_separation) if ordered else (F.abs(F.col("j") - F.col("i")) >= min_separation)
    return (
        i_side.join(j_side, [*keys, "cx", "cy", "cz"])
        .where(apart)
        .select(*keys, "i", "j", *[f"{c}_{s}" for c in carry for s in "ij"], distance.alias("distance"))
        .where(F.col("distance") <= radius)
    )


def nearest_nonadjacent(points: DataFrame, keys: Sequence[str], radius: float, gap: int = 2) -> DataFrame:
    """Distance from each resolved point to the closest one at least ``gap`` positions away.

    A hit within ``radius`` is exact, whatever lies beyond.  Only the isolated points
    left without one are compared with their whole group, so choose a radius that
    nearly every point meets.
    """
    keys = list(keys)
    resolved = points.where(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()).select(*keys, "pos", "x", "y", "z")
    near = radius_pairs(resolved, resolved, keys, radius, gap, ordered=False).select(*keys, F.col("i").alias("pos"), "distance")
    found = near.groupBy(*keys, "pos").agg(F.min("distance").alias("nearest"))
    isolated = resolved.join(found, [*keys, "pos"], "left_anti")
    other = resolved.select(*keys, F.col("pos").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"), F.col("z").alias("zj"))
    distance = F.sqrt(sum(((F.col(a) - F.col(f"{a}j")) * (F.col(a) - F.col(f"{a}j")) for a in "xyz"), F.lit(0.0)))
    rest = (
        isolated.join(other, keys)
        .where(F.abs(F.col("j") - F.col("pos")) >= gap)
        .groupBy(*keys, "pos")
        .agg(F.min(distance).alias("nearest"))
    )
    return found.unionByName(rest)


def source_pairs(candidates: DataFrame, target: str, kind: str, confidence: str, cid: str, first: str, second: str, m: int, n: int) -> DataFrame:
    """Best m of one kind with best n of the other, per target."""
    order = Window.partitionBy(target, kind).orderBy(F.desc(confidence), cid)
    ranked = candidates.where(F.col(kind).isin(first, second)).select(
        target, kind, cid, F.row_number().over(order).alias("_r")
    )
    one = ranked.where((F.col(kind) == first) & (F.col("_r") <= m)).select(target, F.col(cid).alias(f"{first}_id"))
    two = ranked.where((F.col(kind) == second) & (F.col("_r") <= n)).select(target, F.col(cid).alias(f"{second}_id"))
    return one.join(two, target)


def restrict(points: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    return points.join(targets.select(key), key, "left_semi")


def replace_failed(full: DataFrame, cohort: DataFrame, failed: DataFrame, split: str, key: str, date: str, order: Sequence[str], family: str) -> DataFrame:
    """Swap each split's failed member for the first unused later row, else the nearest earlier one.

    ``failed`` holds one key per split.  Fails the job if a replacement's family
    already belongs to another split.
    """
    placed = positions(full, [split], [date, *order], F.to_date(date))
    at = placed.join(failed, key, "left_semi").select(split, F.col("pos").alias("_at"))
    unused = placed.join(cohort.select(key), key, "left_anti").join(at, split)
    step = F.col("pos") - F.col("_at")
    # Later rows come first in forward order, then earlier ones in backward order.
    preference = F.struct((step < 0).alias("earlier"), F.abs(step).alias("step"))
    chosen = (
        unused.groupBy(split)
        .agg(F.min_by(F.struct(*full.columns), preference).alias("_r"))
        .select(*[F.col("_r")[c].alias(c) for c in full.columns])
        .select(*cohort.columns)
    )
    repaired = cohort.join(failed, key, "left_anti").withColumn("replacement", F.lit(False)).unionByName(
        chosen.withColumn("replacement", F.lit(True))
    )
    crossing = (
        repaired.groupBy(family)
        .agg(F.min(split).alias("_lo"), F.max(split).alias("_hi"))
        .where(F.col("_lo") != F.col("_hi"))
        .select(family)
        .withColumn("_crosses", F.lit(True))
    )
    checked = repaired.join(crossing, family, "left")
    return checked.withColumn(
        key, F.when(F.col("_crosses") & F.col("replacement"), F.raise_error(F.lit("replacement makes a family cross splits")).cast(full.schema[key].dataType)).otherwise(F.col(key))
    ).drop("_crosses")


def coverage_check(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many distinct keys of each side have a counterpart."""
    left = a.select(*keys).distinct().withColumn("_a", F.lit(1))
    right = b.select(*keys).distinct().withColumn("_b", F.lit(1))
    in_a, in_b = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    return left.join(right, list(keys), "full").agg(
        F.count_if(in_a).alias("n_a"),
        F.count_if(in_b).alias("n_b"),
        F.count_if(in_a & in_b).alias("both"),
        F.count_if(in_a & ~in_b).alias("only_a"),
        F.count_if(~in_a & in_b).alias("only_b"),
        (100.0 * F.count_if(in_a & in_b) / F.count_if(in_a)).alias("pct_a_covered"),
    )


def allocation_grid(targets: DataFrame, allocations: Sequence[tuple[int, int]], settings: Sequence[str]) -> DataFrame:
    """Every allocation and setting a target can fill: literal grid, filtered by what is available."""
    grid = F.array(
        *[F.struct(F.lit(t).alias("n_t"), F.lit(d).alias("n_d"), F.lit(s).alias("setting")) for t, d in allocations for s in settings]
    )
    spread = targets.withColumn("_g", F.explode(grid)).select(*targets.columns, "_g.*")
    return spread.where((F.col("n_t") <= F.col("available_t")) & (F.col("n_d") <= F.col("available_d")))
