"""Grouped summaries of panels, cohorts and point chains."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainwright.operators import order
from chainwright.operators.topk import topn


def resolved_stats(points: DataFrame, keys: Sequence[str], resolved: Column, least: int = 3, share: float = 0.8) -> DataFrame:
    """Rows, resolved rows, their share, and whether both are enough."""
    return (
        points.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("residues"), F.count_if(resolved).alias("resolved"))
        .withColumn("resolved_fraction", F.col("resolved") / F.col("residues"))
        .withColumn("valid", (F.col("resolved") >= least) & (F.col("resolved_fraction") >= share))
    )


def metric_means(df: DataFrame, sets: Sequence[Sequence[str]], values: Sequence[str]) -> DataFrame:
    """Means over several grouping sets in one pass; grouped-out keys are NULL."""
    keys = sorted({k for s in sets for k in s})
    grouped = df.groupingSets([list(s) for s in sets], *keys) if len(sets) > 1 else df.groupBy(*keys)
    return grouped.agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(f"mean_{v}") for v in values])


def best_of(scores: DataFrame, target: Sequence[str], value: str) -> DataFrame:
    """Best value over every prediction and reference of a target."""
    return scores.groupBy(*target).agg(F.max(value).alias("best"))


def two_level_mean(df: DataFrame, inner: Sequence[str], outer: Sequence[str], value: str) -> DataFrame:
    """Mean inside inner groups first, so large ones do not dominate."""
    first = df.groupBy(*inner).agg(F.avg(value).alias("_v"), F.count(F.lit(1)).alias("_n"))
    return first.groupBy(*outer).agg(F.avg("_v").alias("mean"), F.count("_v").alias("groups"), F.sum("_n").alias("rows"))


def mean_std_count(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("count"))


def pivot_delta(df: DataFrame, keys: Sequence[str], column: str, value: str, a: str, b: str) -> DataFrame:
    wide = df.groupBy(*keys).agg(
        F.avg(F.when(F.col(column) == a, F.col(value))).alias("a"), F.avg(F.when(F.col(column) == b, F.col(value))).alias("b")
    )
    return wide.withColumn("delta", F.col("b") - F.col("a"))


def describe_cohort(df: DataFrame, keys: Sequence[str], length: str, date: str, family: str) -> DataFrame:
    """Size, length range and exact median, date range and families per cohort."""
    plain = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("targets"),
        F.min(length).alias("min_length"),
        F.max(length).alias("max_length"),
        F.min(date).alias("first_date"),
        F.max(date).alias("last_date"),
        F.count_distinct(family).alias("families"),
    )
    median = order.percentiles(df, keys, length, {"median_length": 0.5}).drop("n")
    return order.join_on(plain, median, list(keys), "left")


def profile(df: DataFrame, target: str, length: str) -> DataFrame:
    """One-row table profile; the exact median arrives as a scalar subquery."""
    median = order.percentiles(df, [], length, {"m": 0.5}).select("m")
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(target).alias("targets"),
        F.sum(length).alias("residues"),
        F.min(length).alias("min_length"),
        F.avg(length).alias("mean_length"),
        F.max(length).alias("max_length"),
    ).withColumn("median_length", median.scalar())


def value_counts(df: DataFrame, columns: Sequence[str], n: int) -> DataFrame:
    counts = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), *columns).limit(n)


def funnel(df: DataFrame, stages: Mapping[str, Column], cluster: str) -> DataFrame:
    """Rows and distinct clusters that reach each stage; conditions accumulate.

    Each row is reduced to how deep it gets, so one aggregation per (cluster,
    depth) serves all stages.
    """
    depth = F.lit(0)
    alive = F.lit(True)
    for condition in stages.values():
        alive = alive & F.coalesce(condition, F.lit(False))
        depth = depth + alive.cast("int")
    per_cluster = df.groupBy(cluster, depth.alias("_depth")).agg(F.count(F.lit(1)).alias("_n"))
    deepest = per_cluster.groupBy(cluster).agg(
        *[F.sum(F.when(F.col("_depth") >= i, F.col("_n")).otherwise(0)).alias(f"_s{i}") for i in range(1, len(stages) + 1)]
    )
    wide = deepest.agg(
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("stage"), F.lit(name).alias("name"), F.sum(f"_s{i}").alias("rows"), F.count_if(F.col(f"_s{i}") > 0).alias("clusters")
                )
                for i, name in enumerate(stages, 1)
            ]
        ).alias("_f")
    )
    return wide.select(F.inline("_f"))


def oracle_regret(scores: DataFrame, target: str, kind: str, value: str, selected: Column, first: str, second: str) -> DataFrame:
    """Selected best, best per kind, best overall, gain and regret, from one aggregation."""
    of = lambda c: F.max(F.when(c, F.col(value)))
    table = scores.groupBy(target).agg(
        of((F.col(kind) == first) & selected).alias("selected_best"),
        of(F.col(kind) == first).alias("first_oracle"),
        of(F.col(kind) == second).alias("second_oracle"),
        of(F.col(kind).isin(first, second)).alias("union_oracle"),
    )
    return table.withColumns(
        {
            "gain": F.col("union_oracle") - F.col("first_oracle"),
            "regret": F.col("union_oracle") - F.col("selected_best"),
        }
    )


def regret_summary(table: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    gain = F.col("gain")
    return table.agg(
        F.count(F.lit(1)).alias("targets"),
        F.avg("selected_best").alias("mean_selected"),
        F.avg("union_oracle").alias("mean_oracle"),
        F.avg("gain").alias("mean_gain"),
        F.avg("regret").alias("mean_regret"),
        F.count_if(gain > tolerance).alias("improved"),
        F.count_if(F.abs(gain) <= tolerance).alias("tied"),
    )


def source_oracle(scores: DataFrame, target: str, source: str, value: str, sources: Sequence[str]) -> DataFrame:
    """Best per source, best overall, and which source won (first of equals)."""
    table = scores.groupBy(target).agg(*[F.max(F.when(F.col(source) == s, F.col(value))).alias(f"best_{s}") for s in sources])
    top = F.greatest(*[F.col(f"best_{s}") for s in sources])
    winner = F.coalesce(*[F.when(F.col(f"best_{s}") == top, F.lit(s)) for s in sources])
    return table.withColumn("union_best", top).withColumn("winner", winner)


def bank_diversity(vectors: DataFrame, bank: Sequence[str], vid: str, vector: str, similar: Column, near: float = 0.95, block: int = 256) -> DataFrame:
    """Mean pairwise similarity and share of near duplicates of each bank.

    ``similar`` is an expression on the columns va and vb. The pairs of a bank are the result's
    own size; they are spread over cells of at most ``block`` by ``block`` rows, so a large bank is many tasks.
    """
    bank = list(bank)
    sized = order.attach(vectors.select(*bank, F.col(vid).alias("_i"), F.col(vector).alias("_v")), bank, F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_parts"))
    dealt = sized.withColumn("_at", F.pmod(F.xxhash64("_i"), F.col("_parts")).cast("int"))
    a = dealt.select(*bank, F.col("_i").alias("ia"), F.col("_v").alias("va"), F.col("_at").alias("_x"), F.explode(F.sequence("_at", F.col("_parts") - 1)).alias("_y"))
    b = dealt.select(*bank, F.col("_i").alias("ib"), F.col("_v").alias("vb"), F.col("_at").alias("_y"), F.explode(F.sequence(F.lit(0), F.col("_at"))).alias("_x"))
    met = order.join_on(a, b, [*bank, "_x", "_y"]).where((F.col("_x") < F.col("_y")) | (F.col("ia") < F.col("ib")))
    pairs = met.select(*bank, similar.alias("_s"))
    return pairs.groupBy(*bank).agg(
        F.count(F.lit(1)).alias("pairs"),
        F.avg("_s").alias("mean_similarity"),
        (F.count_if(F.col("_s") >= near) / F.count(F.lit(1))).alias("near_duplicate_fraction"),
    )


def stratify(df: DataFrame, label: Column, number: Column, values: Sequence[str]) -> DataFrame:
    """Means per named bin, with the bin's fixed order number."""
    return df.groupBy(label.alias("bin"), number.alias("bin_order")).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(f"mean_{v}") for v in values]
    )


def reason_set(events: DataFrame, keys: Sequence[str], reason: str) -> DataFrame:
    """Distinct reasons per key, sorted and joined; the vocabulary bounds the array."""
    return events.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(reason)), "|").alias("reasons"))


def power_law_fit(df: DataFrame, x: str, y: str, least_x: float = 5) -> DataFrame:
    """Least squares of log y on log x over admissible rows: y = a * x ** b."""
    usable = df.where((F.col(x) >= least_x) & (F.col(y) > 0)).select(F.log(x).alias("_x"), F.log(y).alias("_y"))
    return usable.agg(
        F.exp(F.regr_intercept("_y", "_x")).alias("a"), F.regr_slope("_y", "_x").alias("b"), F.count(F.lit(1)).alias("n")
    )


def trimmed_stats(df: DataFrame, value: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Mean, std and median of the values between two percentiles, with the outer p05/p95."""
    outer = order.percentiles(df, [], value, {"lo": low, "hi": high, "p05": 0.05, "p95": 0.95})
    bounds = outer.select(F.struct("lo", "hi", "p05", "p95")).scalar()
    kept = df.where(F.col(value).isNotNull()).withColumn("_b", bounds).where(F.col(value).between(F.col("_b.lo"), F.col("_b.hi")))
    median = order.percentiles(kept.select(value), [], value, {"m": 0.5}).select("m").scalar()
    return kept.agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(F.lit(1)).alias("n"), F.max("_b.p05").alias("p05"), F.max("_b.p95").alias("p95")
    ).withColumn("median", median)


def clash_radius(nearest: DataFrame, value: str, floor: float, percentile: float = 0.01) -> DataFrame:
    """Low percentile of the physical distances, never below the floor."""
    physical = nearest.where(F.col(value) >= floor)
    return order.percentiles(physical, [], value, {"p": percentile}).select(
        F.greatest(F.lit(floor), F.col("p")).alias("r_min"), F.col("n").alias("n")
    )


def binned_median(df: DataFrame, bin_column: Column, value: str, least: int = 3) -> DataFrame:
    """Exact median per bin, for bins with enough members."""
    binned = df.withColumn("bin", bin_column).where(F.col("bin").isNotNull())
    return order.percentiles(binned, ["bin"], value, {"median": 0.5}).where(F.col("n") >= least)


def radius_of_gyration(points: DataFrame, keys: Sequence[str], least: int = 3) -> DataFrame:
    resolved = points.where(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull())
    return (
        resolved.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.var_pop("x") + F.var_pop("y") + F.var_pop("z")).alias("rg"))
        .where(F.col("n") >= least)
    )


def retrieval_quality(scores: DataFrame, keys: Sequence[str], order_by: Sequence[Column], value: str, entity: str, coverage: str, useful: float) -> DataFrame:
    """First hit, best of five, whether any is useful, useful recall, entities and mean coverage.

    Only five ranked rows per key are needed; the number of useful rows is a plain count.
    """
    first = topn(scores, keys, order_by, 5, rank="_r")
    good = F.col(value) >= useful
    ranked = first.groupBy(*keys).agg(
        F.max(F.when(F.col("_r") == 1, F.col(value))).alias("top1"),
        F.max(value).alias("best5"),
        F.bool_or(good).alias("useful_hit"),
        F.count_if(good).alias("_found"),
        F.count_distinct(entity).alias("entities"),
        F.avg(coverage).alias("mean_coverage"),
    )
    every = scores.groupBy(*keys).agg(F.count_if(good).alias("_all"))
    return ranked.join(every, list(keys)).withColumn("useful_recall", F.col("_found") / F.nullif("_all", F.lit(0))).drop("_found", "_all")


def audit_rollup(df: DataFrame, keys: Sequence[str], ok: Column, ready: Column, error: str) -> DataFrame:
    """Counts per split and its first three distinct errors in order.

    The errors are ranked after reduction to distinct texts, so no group of rows
    is collected.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("targets"), F.count_if(ok).alias("ok"), F.count_if(ready).alias("ready"))
    first = topn(df.where(F.col(error).isNotNull()).select(*keys, error).distinct(), keys, [F.col(error)], 3)
    joined = first.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(error)), " | ").alias("errors"))
    return counts.join(joined, list(keys), "left")
