"""Paired effects, resampling inference, rank correlation and classifier evaluation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainwright.functions.sequence import draw
from chainwright.operators import order
from chainwright.session import stash


# ---------------------------------------------------------------- paired effects and resampling


def paired_summary(df: DataFrame, keys: Sequence[str], baseline: str, method: str, higher: bool = True, tie: float = 1e-12, strict_tie: bool = False) -> DataFrame:
    """Oriented paired deltas: count, mean, exact median, improved / tied / regressed."""
    keys = list(keys)
    raw = F.col(method) - F.col(baseline)
    deltas = df.withColumn("_d", raw if higher else -raw).where(F.col("_d").isNotNull() & ~F.isnan("_d"))
    tied = F.abs("_d") < tie if strict_tie else F.abs("_d") <= tie
    counts = deltas.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("targets"),
        F.avg("_d").alias("mean_delta"),
        F.count_if(F.col("_d") > tie).alias("improved"),
        F.count_if(tied).alias("tied"),
        F.count_if(F.col("_d") < -tie).alias("regressed"),
    )
    median = order.percentiles(deltas, keys, "_d", {"median_delta": 0.5}).drop("n")
    return order.join_on(counts, median, keys) if keys else counts.withColumn("median_delta", median.scalar())


def units(df: DataFrame, keys: Sequence[str], unit: str, value: str) -> DataFrame:
    """Sum and size per resampling unit with its ordinal and the number of units.

    Numbers are numbered in their order, other ids in the order of their digest; a NULL unit is one unit, the last one.
    """
    keys = list(keys)
    sums = df.groupBy(*keys, unit).agg(F.sum(value).alias("total"), F.count(value).alias("size"))
    if isinstance(df.schema[unit].dataType, T.NumericType):
        places = order.value_ranks(sums, keys, unit).select(*keys, unit, F.col("before").alias("ordinal"), F.col("n").alias("_known"))
        placed = order.join_on(sums, places, [*keys, unit], "left")
        counted = order.attach(placed, keys, F.count(F.lit(1)).alias("units")) if keys else placed.withColumn("units", placed.agg(F.count(F.lit(1))).scalar())
        return counted.withColumn("ordinal", F.coalesce("ordinal", F.col("units") - 1)).drop("_known")
    mark = F.coalesce(F.md5(F.col(unit).cast("string")), F.lit("g"))
    place = order.positions(sums.withColumn("_md5", mark), keys, ["_md5"], F.substring("_md5", 1, 3), name="ordinal", total="units")
    return place.drop("_md5")


def bootstrap(df: DataFrame, keys: Sequence[str], unit: str, value: str, replicates: int, seed: int) -> DataFrame:
    """Replicate means from resampled units that carry all their members (ratio of sums).

    Unit i of n fills slot i of every replicate with unit ``draw(seed | replicate | i) mod n``,
    so draws do not depend on partitioning and the join key is spread evenly.
    """
    keys = list(keys)
    table = units(df, keys, unit, value)
    slots = table.select(*keys, "units", F.col("ordinal").alias("_slot"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    drawn = slots.select(*keys, "replicate", draw(F.col("units"), str(seed), F.col("replicate"), F.col("_slot")).alias("ordinal"))
    return (
        order.join_on(drawn, table.select(*keys, "ordinal", "total", "size"), [*keys, "ordinal"])
        .groupBy(*keys, "replicate")
        .agg((F.sum("total") / F.sum("size")).alias("mean"))
    )


def interval(replicates: DataFrame, keys: Sequence[str], low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Percentile interval; the number of replicates bounds each group."""
    both = F.percentile("mean", F.array(F.lit(low), F.lit(high)))
    return replicates.groupBy(*keys).agg(both.alias("_q")).select(*keys, F.get("_q", F.lit(0)).alias("ci_low"), F.get("_q", F.lit(1)).alias("ci_high"))


def sign_flip(df: DataFrame, unit: str, value: str, permutations: int, seed: int, slack: float = 0.0) -> DataFrame:
    """One-sided Monte-Carlo p-value with one shared sign per unit: (1 + exceed) / (1 + N); ``slack`` counts near ties as ties."""
    table = units(df, [], unit, value)
    observed = df.agg(F.avg(value)).scalar()
    rows = df.agg(F.count(value)).scalar()
    sign = 1 - 2 * draw(F.lit(2), str(seed), F.col("permutation"), F.col("ordinal"))
    flips = table.select("ordinal", "total", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("permutation"))
    null = flips.groupBy("permutation").agg(F.sum(F.col("total") * sign).alias("_t"))
    return null.withColumns({"_o": observed, "_n": rows}).agg(
        F.max("_o").alias("observed"), ((1.0 + F.count_if(F.col("_t") / F.col("_n") >= F.col("_o") - slack)) / (permutations + 1.0)).alias("p_value")
    )


def exact_sign_flip(df: DataFrame, unit: str, value: str, slack: float = 1e-15) -> DataFrame:
    """Exact p-values over all 2 ** n sign allocations of the n units.

    The allocations are made in two steps of rows, each with the unit totals as one array, and summed where they are made.
    """
    table = units(df, [], unit, value)
    one = table.agg(F.array_sort(F.collect_list(F.struct("ordinal", "total"))).alias("_u"), F.count(F.lit(1)).alias("units"))
    low = F.least(F.lit(14), F.col("units"))
    power = lambda n: F.pow(F.lit(2.0), n).cast("long")
    upper = one.select("*", F.explode(F.sequence(F.lit(0).cast("long"), power(F.col("units") - low) - 1)).alias("_high")).repartition("_high")
    masks = upper.select("_u", "units", (F.col("_high") * power(low)).alias("_base"), F.explode(F.sequence(F.lit(0).cast("long"), power(low) - 1)).alias("_low"))
    masks = masks.withColumn("mask", F.col("_base") + F.col("_low"))
    signed = F.transform("_u", lambda u, i: u["total"] * (1 - 2 * F.getbit("mask", i)))
    null = masks.select(F.aggregate(signed, F.lit(0.0), lambda a, x: a + x).alias("_t"), F.col("units").alias("_u"))
    stats = null.withColumns({"_o": df.agg(F.avg(value)).scalar(), "_n": df.agg(F.count(value)).scalar()}).withColumn("_s", F.col("_t") / F.col("_n"))
    return stats.agg(
        F.max("_o").alias("observed"),
        F.max("_n").alias("targets"),
        F.max("_u").alias("units"),
        F.count(F.lit(1)).alias("permutations"),
        F.avg((F.abs("_s") >= F.abs("_o") - slack).cast("double")).alias("two_sided_p"),
        F.avg((F.col("_s") >= F.col("_o") - slack).cast("double")).alias("greater_p"),
    )


def primary_inference(df: DataFrame, target: str, cluster: str, value: str, replicates: int, permutations: int, seed: int, tie: float = 1e-6, slack: float = 0.0) -> DataFrame:
    """Effect, interval, p-value and counts in one row; bad deltas or blank clusters fail the job."""
    bad = F.col(value).isNull() | F.isnan(value) | F.col(cluster).isNull() | (F.col(cluster).cast("string") == "")
    checked = df.withColumn(value, F.when(bad, F.raise_error(F.lit("non-finite delta or blank cluster")).cast("double")).otherwise(F.col(value)))
    zero = checked.withColumn("_zero", F.lit(0.0))
    row = paired_summary(zero, [], "_zero", value, tie=tie, strict_tie=True)
    ci = interval(bootstrap(checked, [], cluster, value, replicates, seed), []).select(F.struct("ci_low", "ci_high")).scalar()
    p = sign_flip(checked, cluster, value, permutations, seed, slack).select("p_value").scalar()
    n = checked.agg(F.count_distinct(cluster)).scalar()
    return row.withColumn("_ci", ci).select(
        "targets", n.alias("clusters"), "mean_delta", "median_delta", F.col("_ci.ci_low").alias("ci_low"), F.col("_ci.ci_high").alias("ci_high"), p.alias("p_value"), "improved", "tied", "regressed"
    )


def holm(df: DataFrame, keys: Sequence[str], name: str, p: str, alpha: float = 0.05) -> DataFrame:
    """Step-down adjustment inside each family of hypotheses."""
    family = Window.partitionBy(*keys)
    ordered = family.orderBy(p, name)
    running = ordered.rowsBetween(Window.unboundedPreceding, 0)
    ranked = df.withColumn("rank", F.row_number().over(ordered)).withColumn("_m", F.count(F.lit(1)).over(family) - F.col("rank") + 1)
    ranked = ranked.withColumn("threshold", alpha / F.col("_m"))
    return ranked.withColumns(
        {
            "adjusted": F.least(F.lit(1.0), F.max(F.col("_m") * F.col(p)).over(running)),
            "reject": F.min((F.col(p) <= F.col("threshold")).cast("int")).over(running) == 1,
        }
    ).drop("_m")


def stratified_effects(df: DataFrame, stratum: str, target: str, baseline: str, method: str, replicates: int, seed: int) -> DataFrame:
    """Effects per stratum, averaged inside a target first, with a target bootstrap."""
    means = df.groupBy(stratum, target).agg(F.avg(baseline).alias("_a"), F.avg(method).alias("_b")).withColumn("_delta", F.col("_b") - F.col("_a"))
    return order.join_on(paired_summary(means, [stratum], "_a", "_b"), interval(bootstrap(means, [stratum], target, "_delta", replicates, seed), [stratum]), [stratum])


def factorial(df: DataFrame, target: str, row: str, column: str, rows: tuple[str, str], columns: tuple[str, str], value: str) -> tuple[DataFrame, DataFrame]:
    """Cell means, and simple effects with their interaction as paired summaries."""
    cells = df.where(F.col(row).isin(*rows) & F.col(column).isin(*columns)).groupBy(row, column).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("count")
    )
    at = lambda r, c: F.avg(F.when((F.col(row) == r) & (F.col(column) == c), F.col(value))).alias(f"_{rows.index(r)}{columns.index(c)}")
    wide = df.groupBy(target).agg(*[at(r, c) for r in rows for c in columns])
    c = F.col
    effects = {
        "row_effect_first": c("_10") - c("_00"),
        "row_effect_second": c("_11") - c("_01"),
        "column_effect_first": c("_01") - c("_00"),
        "column_effect_second": c("_11") - c("_10"),
        "interaction": (c("_11") - c("_10")) - (c("_01") - c("_00")),
    }
    long = wide.select(target, F.inline(F.array(*[F.struct(F.lit(n).alias("effect"), e.alias("delta")) for n, e in effects.items()])))
    return cells, paired_summary(long.withColumn("_zero", F.lit(0.0)), ["effect"], "_zero", "delta")


def compare_stages(df: DataFrame, target: str, setting: str, value: str, comparisons: Sequence[tuple[str, str, str]], extra: Sequence[str] = ()) -> DataFrame:
    """Long frame (comparison, target, baseline, method) for named (name, before, after) pairs.

    The comparison list is a literal array on each pivoted target, not a join.
    """
    names = sorted({s for _, a, b in comparisons for s in (a, b)})
    wide = df.groupBy(*extra, target).agg(*[F.avg(F.when(F.col(setting) == s, F.col(value))).alias(f"_v_{s}") for s in names])
    rows = F.array(*[F.struct(F.lit(n).alias("comparison"), F.col(f"_v_{a}").alias("baseline"), F.col(f"_v_{b}").alias("method")) for n, a, b in comparisons])
    return wide.select(*extra, target, F.inline(rows))


def effect_grid(df: DataFrame, target: str, cluster: str, setting: str, metrics: Mapping[str, bool], comparisons: Sequence[tuple[str, str, str]], replicates: int, seed: int) -> DataFrame:
    """Every comparison and metric, oriented so that positive is better, with a cluster bootstrap."""
    long = df.select(target, cluster, setting, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("_value"), F.lit(1.0 if up else -1.0).alias("_sign")) for m, up in metrics.items()])))
    oriented = long.withColumn("_value", F.col("_value") * F.col("_sign"))
    staged = compare_stages(oriented, target, setting, "_value", comparisons, extra=[cluster, "metric"])
    deltas = staged.withColumn("_delta", F.col("method") - F.col("baseline")).where(F.col("_delta").isNotNull())
    keys = ["comparison", "metric"]
    return order.join_on(paired_summary(deltas, keys, "baseline", "method"), interval(bootstrap(deltas, keys, cluster, "_delta", replicates, seed), keys), keys)


def decide(df: DataFrame, low: str, effect: str, margin: float) -> DataFrame:
    """Superior if the interval lies above 0, non-inferior if above -margin, and both with a positive effect."""
    superior, safe = F.col(low) > 0, F.col(low) > -margin
    return df.withColumns({"superior": superior, "non_inferior": safe, "accepted": safe & (F.col(effect) > 0)})


def relative_change(before: Column, after: Column) -> Column:
    return 100.0 * (after - before) / F.nullif(F.abs(before), F.lit(0.0))


# ---------------------------------------------------------------- rank correlation


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, least: int = 2) -> DataFrame:
    """Rank correlation per key; NULL with too few rows or a constant side."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"))
    ranked = order.with_average_rank(order.with_average_rank(rows, keys, "_x", "_rx"), keys, "_y", "_ry")
    usable = (F.count(F.lit(1)) >= least) & (F.max("_rx_span") > 0) & (F.max("_ry_span") > 0)
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.when(usable, F.corr("_rx", "_ry")).alias("rho"))


def spearman_report(df: DataFrame, target: str, x: str, y: str, digits: int = 9) -> DataFrame:
    """Pooled, group-centred and mean within-group rank correlation."""
    pooled = spearman(df, [], x, y)
    means = order.attach(df, [target], F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    centred = means.select(F.round(F.col(x) - F.col("_mx"), digits).alias("cx"), F.round(F.col(y) - F.col("_my"), digits).alias("cy"))
    within = spearman(df, [target], x, y).where(F.col("rho").isNotNull() & ~F.isnan("rho")).agg(F.struct(F.avg("rho").alias("mean"), F.count(F.lit(1)).alias("n")))
    return (
        pooled.withColumnRenamed("rho", "pooled_rho")
        .withColumn("centred_rho", spearman(centred, [], "cx", "cy").select("rho").scalar())
        .withColumn("_w", within.scalar())
        .select("n", "pooled_rho", "centred_rho", F.col("_w.mean").alias("mean_within_rho"), F.col("_w.n").alias("groups_within"))
    )


def spearman_by(df: DataFrame, source: str, target: str, x: str, y: str, least_rows: int = 5, digits: int = 9) -> DataFrame:
    """Pooled and target-centred correlation per source with enough rows."""
    centred = order.attach(df, [source, target], F.avg(x).alias("_mx"), F.avg(y).alias("_my")).select(
        source, F.round(F.col(x) - F.col("_mx"), digits).alias("cx"), F.round(F.col(y) - F.col("_my"), digits).alias("cy")
    )
    pooled = spearman(df, [source], x, y, least=4).withColumnRenamed("rho", "pooled_rho")
    inner = spearman(centred, [source], "cx", "cy", least=4).select(source, F.col("rho").alias("centred_rho"))
    return pooled.join(inner, source).where(F.col("n") >= least_rows)


def label_agreement(df: DataFrame, target: str, advantages: Sequence[str], digits: int = 9) -> DataFrame:
    """For each pair of label definitions: equal decisions and rank correlations over the rows that have both.

    Equal rows are counted first.  Each label is ranked once for all its pairs, and the ranks are written before
    they meet the rows, so those of few values are broadcast.
    """
    names = list(advantages)
    m = len(names)
    centred = order.attach(df, [target], *[F.avg(a).alias(f"_m_{a}") for a in names])
    values = [F.col(a).cast("double").alias(f"_v{i}") for i, a in enumerate(names)]
    values += [F.round(F.col(a) - F.col(f"_m_{a}"), digits).cast("double").alias(f"_v{m + i}") for i, a in enumerate(names)]
    every = [f"_v{s}" for s in range(2 * m)]
    rows = stash(centred.select(*values).groupBy(*every).agg(F.count(F.lit(1)).alias("_w")), "rows")
    has = lambda j: F.col(f"_v{j}").isNotNull()
    ranks = stash(_label_ranks(rows, m), "ranks")
    met = rows
    for s in range(2 * m):
        one = stash(ranks.where(F.col("_s") == s).select(F.col("_v").alias(f"_v{s}"), *[F.col(f"_r{j}").alias(f"_r{s}_{j}") for j in range(m) if j != s % m]), "ranks")
        met = met.join(one, f"_v{s}", "left")
        if s >= m:
            met = met.drop(f"_v{s}")
    sums, out = [], []
    for i in range(m):
        for j in range(i + 1, m):
            name, w = f"{i}_{j}", F.col("_w")
            equal = (F.col(f"_v{i}") > 0) == (F.col(f"_v{j}") > 0)
            sums += [F.sum(F.when(equal, w).when(~equal, F.lit(0))).alias(f"_e{name}"), F.sum(F.when(has(i) & has(j), w)).alias(f"_n{name}")]
            rho = []
            for kind, base in (("p", 0), ("c", m)):
                x, y = (F.when(has(i) & has(j), F.col(c)) for c in (f"_r{base + i}_{j}", f"_r{base + j}_{i}"))
                sums += [F.sum(w * p * q).alias(f"_{kind}{k}{name}") for k, p, q in (("xy", x, y), ("xx", x, x), ("yy", y, y))]
                xy, xx, yy = (F.col(f"_{kind}{k}{name}") for k in ("xy", "xx", "yy"))
                rho.append(F.when((F.col(f"_n{name}") >= 2) & (xx > 0) & (yy > 0), xy / F.sqrt(xx) / F.sqrt(yy)))
            n = F.col(f"_n{name}")
            out.append(F.struct(F.lit(names[i]).alias("label_a"), F.lit(names[j]).alias("label_b"), (F.col(f"_e{name}") / n).alias("decision_agreement"), n.alias("n"), rho[0].alias("pooled_rho"), rho[1].alias("centred_rho")))
    return met.agg(*sums).select(F.inline(F.array(*out))).where("n > 0")


def _label_ranks(rows: DataFrame, m: int) -> DataFrame:
    """Tie-averaged ranks, less their mean, of each distinct value ``_v`` of column ``_s``: ``_r<j>`` among the rows that also have label ``j``."""
    partners = range(m)
    with_label = F.array(*[F.when(F.col(f"_v{j}").isNotNull(), F.col("_w")).otherwise(F.lit(0).cast("long")) for j in partners])
    sides = F.array(*[F.struct(F.lit(s).alias("_s"), F.col(f"_v{s}").alias("_v")) for s in range(2 * m)])
    long = rows.select(with_label.alias("_k"), F.inline(sides)).where("_v IS NOT NULL")
    counted = long.groupBy("_s", "_v").agg(*[F.sum(F.get("_k", F.lit(j))).alias(f"_c{j}") for j in partners]).withColumn("_bucket", order.order_bucket(F.col("_v")))
    per = counted.groupBy("_s", "_bucket").agg(*[F.sum(f"_c{j}").alias(f"_in{j}") for j in partners])
    side = Window.partitionBy("_s")
    prefix = per.select(
        "_s", "_bucket", *[(F.sum(f"_in{j}").over(side.orderBy("_bucket")) - F.col(f"_in{j}")).alias(f"_ahead{j}") for j in partners], *[F.sum(f"_in{j}").over(side).alias(f"_n{j}") for j in partners]
    )
    inside = Window.partitionBy("_s", "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    rank = lambda j: F.col(f"_ahead{j}") + F.sum(f"_c{j}").over(inside) - F.col(f"_c{j}") + (F.col(f"_c{j}") + 1) / 2
    return counted.join(prefix, ["_s", "_bucket"]).select("_s", "_v", *[(rank(j) - (F.col(f"_n{j}") + 1) / 2).alias(f"_r{j}") for j in partners])


def source_quality(df: DataFrame, split: str, target: str, labels: Mapping[str, tuple[str, str, str]]) -> DataFrame:
    """Means of both sources and how often the second wins, per split and label definition."""
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("label"), F.lit(d).alias("direction"), F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b"), (F.col(b) > F.col(a) if d == "higher" else F.col(b) < F.col(a)).alias("_w"))
            for n, (a, b, d) in labels.items()
        ]
    )
    long = df.select(split, target, F.inline(rows))
    return long.groupBy(split, "label", "direction").agg(
        F.avg("_a").alias("first_mean"), F.avg("_b").alias("second_mean"), F.avg(F.col("_w").cast("double")).alias("second_better"), F.count_distinct(target).alias("targets"), F.count(F.lit(1)).alias("rows")
    )


# ---------------------------------------------------------------- classifier evaluation
#
# Frames carry grp, y (0/1), p, weight, error_a, error_b.


def classification_metrics(df: DataFrame, keys: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    """Accuracy, balanced accuracy, AUC from average ranks, Brier, 10-bin ECE and weighted cross entropy."""
    keys = list(keys)
    y, p = F.col("y"), F.col("p")
    hit = (p >= threshold).cast("int") == y
    binned = F.least(F.floor(p * 10), F.lit(9)).alias("_bin")
    entropy = -(y * F.log("p") + (1 - y) * F.log(1 - p)) * F.col("weight")
    per_bin = df.groupBy(*keys, binned).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("p").alias("_p"), F.sum("y").alias("_y"), F.sum(hit.cast("int")).alias("_hit"),
        F.sum(F.when(y == 1, hit.cast("int"))).alias("_tp"), F.sum(F.when(y == 0, hit.cast("int"))).alias("_tn"),
        F.sum((p - y) * (p - y)).alias("_b"), F.sum(entropy).alias("_e"),
    )
    total = per_bin.groupBy(*keys).agg(
        F.sum("_n").alias("rows"), F.sum("_y").alias("_pos"), (F.sum("_hit") / F.sum("_n")).alias("accuracy"), F.sum("_tp").alias("_tp"), F.sum("_tn").alias("_tn"),
        (F.sum("_b") / F.sum("_n")).alias("brier"), (F.sum("_e") / F.sum("_n")).alias("weighted_bce"), (F.sum(F.abs(F.col("_p") - F.col("_y"))) / F.sum("_n")).alias("ece"),
    )
    ranked = order.with_average_rank(df.select(*keys, "y", "p"), keys, "p", "_r")
    above = ranked.groupBy(*keys).agg(F.sum(F.when(F.col("y") == 1, F.col("_r"))).alias("_sum"))
    joined = total.join(above, keys) if keys else total.withColumn("_sum", above.scalar())
    pos, neg = F.col("_pos"), F.col("rows") - F.col("_pos")
    return joined.select(
        *keys,
        "rows",
        "accuracy",
        ((F.col("_tp") / F.nullif(pos, F.lit(0)) + F.col("_tn") / F.nullif(neg, F.lit(0))) / 2).alias("balanced_accuracy"),
        ((F.col("_sum") - pos * (pos + 1) / 2) / F.nullif(pos * neg, F.lit(0))).alias("auc"),
        "brier",
        "ece",
        "weighted_bce",
    )


def decision_errors(df: DataFrame, decisions: Mapping[str, Column]) -> DataFrame:
    """Target-mean and row-mean error of each decision rule."""
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.when(d, F.col("error_b")).otherwise(F.col("error_a")).alias("_e"), d.cast("double").alias("_d")) for n, d in decisions.items()])
    long = df.select("grp", F.inline(rows))
    per_target = long.groupBy("rule", "grp").agg(F.avg("_e").alias("_m"), F.sum("_e").alias("_s"), F.sum("_d").alias("_u"), F.count(F.lit(1)).alias("_n"))
    return per_target.groupBy("rule").agg(
        F.avg("_m").alias("target_mean_error"), (F.sum("_s") / F.sum("_n")).alias("row_mean_error"), (F.sum("_u") / F.sum("_n")).alias("second_fraction"), F.count(F.lit(1)).alias("targets"), F.sum("_n").alias("rows")
    )


def rule_baselines(df: DataFrame) -> DataFrame:
    """Fixed rules: always first, always second, gaps, confidence, and the per-row oracle."""
    return decision_errors(
        df,
        {
            "always_first": F.lit(False),
            "always_second": F.lit(True),
            "gap_rule": F.col("gap") >= 1,
            "confidence_rule": F.col("p") > 0.5,
            "oracle": F.col("error_b") < F.col("error_a"),
        },
    )


def calibrate_threshold(df: DataFrame, steps: int = 37, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Threshold with the least target-mean error, then closest to 0.5, then smallest."""
    grid = F.array(*[F.lit(low + (high - low) * i / (steps - 1)) for i in range(steps)])
    long = df.select("grp", "p", "error_a", "error_b", F.explode(grid).alias("threshold"))
    error = F.when(F.col("p") >= F.col("threshold"), F.col("error_b")).otherwise(F.col("error_a"))
    swept = long.groupBy("threshold", "grp").agg(F.avg(error).alias("_m")).groupBy("threshold").agg(F.round(F.avg("_m"), 9).alias("target_mean_error"))
    best = F.struct("target_mean_error", F.round(F.abs(F.col("threshold") - 0.5), 9).alias("d"), "threshold")
    return swept.agg(F.min(best).alias("_b")).select(F.col("_b.threshold").alias("threshold"), F.col("_b.target_mean_error").alias("target_mean_error"))


def beats_all(learned: DataFrame, baselines: DataFrame, error: str) -> DataFrame:
    """The learned rule passes only below every deployable baseline."""
    least = baselines.where(F.col("rule") != "oracle").agg(F.min(error)).scalar()
    return learned.select(F.col(error).alias("learned_error"), least.alias("best_baseline")).withColumn("passes", F.col("learned_error") < F.col("best_baseline"))


def standardize(df: DataFrame, columns: Sequence[str], floor: float = 1e-6) -> DataFrame:
    """Centre and scale with population moments; the moments arrive as one scalar row."""
    moments = df.agg(F.struct(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.greatest(F.stddev_pop(c), F.lit(floor)).alias(f"s_{c}") for c in columns]))
    tagged = df.withColumn("_m", moments.scalar())
    return tagged.withColumns({f"z_{c}": (F.col(c) - F.col(f"_m.m_{c}")) / F.col(f"_m.s_{c}") for c in columns}).drop("_m")


def fit_router(train: DataFrame, calibration: DataFrame, features: Sequence[str], penalties: Sequence[float] = (0.0, 0.01, 0.1), depths: Sequence[int] = (2, 3)) -> DataFrame:
    """Weighted logistic and boosted-tree routers; the best calibrated error wins.

    Returns calibration rows scored by each model with the model's name; ``choose_router`` ranks them.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    head = [VectorAssembler(inputCols=list(features), outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True)]
    common = {"featuresCol": "_x", "labelCol": "y", "weightCol": "weight"}
    models = {f"logistic_{c}": LogisticRegression(regParam=c, maxIter=30, **common) for c in penalties}
    models |= {f"boosted_{d}": GBTClassifier(maxDepth=d, maxIter=10, seed=7, **common) for d in depths}
    scored = None
    for name, model in models.items():
        rows = Pipeline(stages=[*head, model]).fit(train).transform(calibration)
        rows = rows.select("grp", "error_a", "error_b", vector_to_array("probability")[1].alias("p"), F.lit(name).alias("model"))
        scored = rows if scored is None else scored.unionByName(rows)
    return scored


def choose_router(scored: DataFrame, steps: int = 37) -> DataFrame:
    """Best threshold of each model, and the rank of the models by their calibrated error."""
    grid = F.array(*[F.lit(0.05 + 0.9 * i / (steps - 1)) for i in range(steps)])
    long = scored.withColumn("threshold", F.explode(grid))
    error = F.when(F.col("p") >= F.col("threshold"), F.col("error_b")).otherwise(F.col("error_a"))
    swept = long.groupBy("model", "threshold", "grp").agg(F.avg(error).alias("_m")).groupBy("model", "threshold").agg(F.avg("_m").alias("error"))
    best = swept.groupBy("model").agg(F.min(F.struct("error", F.abs(F.col("threshold") - 0.5).alias("d"), "threshold")).alias("_b"))
    # One row per model is ranked here.
    return best.select("model", F.col("_b.threshold").alias("threshold"), F.col("_b.error").alias("error")).withColumn(
        "rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("error", "model"))
    )
