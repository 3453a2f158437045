"""Operators along a chain or a rank: local geometry, runs, gap filling, smoothing, splits and samples."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainwright.functions import vectors as V
from chainwright.operators import order

XYZ = ["x", "y", "z"]


# ---------------------------------------------------------------- local geometry


def adjacent_distance(points: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    """Distance to the previous position where both points are resolved."""
    near = order.at_offsets(points.select(*keys, pos, *XYZ), keys, pos, XYZ, [-1])
    distance = V.norm(V.sub(V.vec(), V.vec("nm1")))
    return near.select(*keys, pos, distance.alias("distance")).where(F.col("distance").isNotNull())


def backbone_dev(points: DataFrame, keys: Sequence[str], pos: str, expected: float | Column) -> DataFrame:
    expected = F.lit(expected) if isinstance(expected, float) else expected
    return adjacent_distance(points, keys, pos).groupBy(*keys).agg(F.avg(F.abs(F.col("distance") - expected)).alias("bb_dev"))


def local_angles(points: DataFrame, keys: Sequence[str], pos: str, extra: Sequence[str] = ()) -> DataFrame:
    """Angle at each position and torsion from it onwards; NULL where points are missing or not consecutive."""
    near = order.at_offsets(points.select(*keys, pos, *XYZ, *extra), keys, pos, XYZ, [-1, 1, 2])
    before, here, after, second = V.vec("nm1"), V.vec(), V.vec("np1"), V.vec("np2")
    return near.select(
        *keys,
        pos,
        *extra,
        V.angle(before, here, after).alias("angle"),
        V.torsion(before, here, after, second).alias("torsion"),
        (V.resolved(before) & V.resolved(here) & V.resolved(after)).alias("angle_valid"),
        (V.resolved(before) & V.resolved(here) & V.resolved(after) & V.resolved(second)).alias("torsion_valid"),
    )


def kink_fraction(points: DataFrame, keys: Sequence[str], pos: str, degrees: float = 70.0) -> DataFrame:
    angles = local_angles(points, keys, pos).where(F.col("angle").isNotNull())
    return angles.groupBy(*keys).agg(F.avg((F.degrees("angle") < degrees).cast("double")).alias("sharp_kinks"))


def sliding_rmsd(pairs: DataFrame, keys: Sequence[str], pos: str, window: int, least: int = 3) -> DataFrame:
    """Per position: the deviation of the window that starts there and the mean over windows that cover it.

    ``pairs``: px..pz and qx..qz.  Chains shorter than the window have one window.
    The superposition sums slide along the chain; no window is solved point by point.
    """
    centred = order.attach(
        pairs, keys, *[F.avg(F.when(F.col("px").isNotNull() & F.col("qx").isNotNull(), F.col(f"{s}{a}"))).alias(f"_m{s}{a}") for s in "pq" for a in "xyz"], F.max(pos).alias("_last")
    )
    p = tuple(F.col(f"p{a}") - F.col(f"_mp{a}") for a in "xyz")
    q = tuple(F.col(f"q{a}") - F.col(f"_mq{a}") for a in "xyz")
    rows = centred.select(*keys, pos, "_last", (V.resolved(p) & V.resolved(q)).alias("shared"), *[c.alias(f"u{i}") for i, c in enumerate(p)], *[c.alias(f"v{i}") for i, c in enumerate(q)])
    u, v = tuple(F.col(f"u{i}") for i in range(3)), tuple(F.col(f"v{i}") for i in range(3))
    sums = order.over_range(rows, keys, pos, V.pair_statistics(u, v), 0, window - 1)
    full = F.col(pos) <= F.greatest(F.col("_last") - (window - 1), F.lit(0))
    scored = V.with_rmsd(sums.select(*keys, pos, "shared", full.alias("full"), *V.STATISTICS), "window_rmsd", least)
    scored = scored.select(*keys, pos, "shared", F.when(F.col("full"), F.col("window_rmsd")).alias("window_rmsd"))
    return order.over_range(scored, keys, pos, {"per_residue": F.avg("window_rmsd")}, -(window - 1), 0).withColumn(
        "per_residue", F.when(F.col("shared"), F.col("per_residue"))
    )


# ---------------------------------------------------------------- runs


def gap_runs(points: DataFrame, keys: Sequence[str], pos: str, present: Column, length: str) -> DataFrame:
    """One row per run of absent positions: start, size, and whether it touches a chain end."""
    near = order.nearest(points.select(*keys, pos, length, present.alias("_ok")), keys, pos, F.col("_ok"))
    start = F.coalesce(F.col("prev.at") + 1, F.lit(0).cast("long"))
    stop = F.coalesce(F.col("next.at") - 1, F.col(length) - 1)
    return near.where(~F.col("_ok") & (F.col(pos) == start)).select(
        *keys,
        start.alias("start"),
        (stop - start + 1).alias("size"),
        (F.col("prev").isNull() | F.col("next").isNull()).alias("terminal"),
    )


def run_mask(points: DataFrame, keys: Sequence[str], pos: str, mask: str, length: str, least: int = 7) -> DataFrame:
    """Keep a true position only in a run of at least ``least``."""
    near = order.nearest(points, keys, pos, ~F.col(mask))
    size = F.coalesce(F.col("next.at"), F.col(length)) - F.coalesce(F.col("prev.at"), F.lit(-1)) - 1
    return near.withColumn("kept", F.col(mask) & (size >= least)).drop("prev", "next")


def distance_to_false(points: DataFrame, keys: Sequence[str], pos: str, mask: str, span: float = 20.0) -> DataFrame:
    """Distance to the closest false position over ``span``, at most 1; 0 where false."""
    near = order.nearest(points, keys, pos, ~F.col(mask))
    steps = F.least(F.col(pos) - F.col("prev.at"), F.col("next.at") - F.col(pos))
    value = F.when(~F.col(mask), F.lit(0.0)).otherwise(F.least(F.coalesce(steps, F.lit(span)) / span, F.lit(1.0)))
    return near.withColumn("support_distance", value).drop("prev", "next")


# ---------------------------------------------------------------- gap filling


def _with_ends(points: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    """Nearest resolved points of each row, and the two outermost resolved points of its chain."""
    near = order.nearest(points.select(*keys, pos, *XYZ), keys, pos, V.resolved(V.vec()), XYZ)
    ok = V.resolved(V.vec())
    own = F.struct(F.col(pos).alias("at"), *XYZ)
    ends = near.groupBy(*keys).agg(
        F.max(F.when(ok & F.col("prev").isNull(), own)).alias("first"),
        F.max(F.when(ok & F.col("prev").isNull(), F.col("next"))).alias("second"),
        F.max(F.when(ok & F.col("next").isNull(), own)).alias("last"),
        F.max(F.when(ok & F.col("next").isNull(), F.col("prev"))).alias("before_last"),
    )
    return near.join(ends, list(keys))


def _emit(rows: DataFrame, keys: Sequence[str], pos: str, cases: Sequence[tuple[Column, V.Vec, Column]]) -> DataFrame:
    """First matching case gives coordinates and confidence."""
    out = []
    for axis in range(3):
        value = None
        for condition, point, _ in cases:
            value = F.when(condition, point[axis]) if value is None else value.when(condition, point[axis])
        out.append(value.alias("xyz"[axis]))
    confidence = None
    for condition, _, c in cases:
        confidence = F.when(condition, c) if confidence is None else confidence.when(condition, c)
    return rows.select(*keys, pos, *out, confidence.alias("confidence"))


def _unit(a: V.Vec, guard: float) -> V.Vec:
    size = V.norm(a) + guard
    return tuple(p / size for p in a)


def fill_gaps(points: DataFrame, keys: Sequence[str], pos: str, spacing: float = 6.0, curved: bool = False) -> DataFrame:
    """Complete chains: linear inside gaps, straight beyond the ends, extended if nothing is resolved.

    ``curved`` bends gaps of three or more with a sine perpendicular to the span.
    Confidence is 1 for resolved points, 0.3 * (1 - |2t - 1|) inside a gap, 0.1
    beyond the ends and 0 for extended chains.
    """
    rows = _with_ends(points, keys, pos)
    at = F.col(pos)
    here, left, right = V.vec(), V.vec("prev"), V.vec("next")
    t = (at - F.col("prev.at")) / (F.col("next.at") - F.col("prev.at"))
    gap = F.col("next.at") - F.col("prev.at") - 1
    seg = V.sub(right, left)
    inner = V.add(V.scale(left, 1 - t), V.scale(right, t))
    if curved:
        rows, d = V.staged(rows, "d", _unit(seg, 1e-8))
        axis = V.pick(F.abs(d[0]) < 0.9, V.const(1, 0, 0), V.const(0, 1, 0))
        rows, side = V.staged(rows, "side", V.sub(axis, V.scale(d, V.dot(axis, d))))
        rows, u = V.staged(rows, "u", _unit(side, 1e-8))
        bump = F.when((gap >= 3) & (V.norm(seg) > 1e-6), F.lit(spacing * 0.5) * F.least(F.lit(1.0), gap / 6.0) * F.sin(t * math.pi)).otherwise(0.0)
        rows = rows.withColumn("bump", bump)
        inner = V.add(V.add(left, V.scale(seg, t)), V.scale(u, F.col("bump")))
    first, second, last, before = V.vec("first"), V.vec("second"), V.vec("last"), V.vec("before_last")
    single = F.col("second").isNull()
    rows, out_left = V.staged(rows, "ol", _unit(V.pick(single, V.const(0, 0, -1), V.sub(first, second)), 1e-8))
    rows, out_right = V.staged(rows, "or", _unit(V.pick(single, V.const(0, 0, 1), V.sub(last, before)), 1e-8))
    cases = [
        (V.resolved(here), here, F.lit(1.0)),
        (F.col("first").isNull(), (F.lit(0.0), F.lit(0.0), at * F.lit(spacing)), F.lit(0.0)),
        (F.col("prev").isNotNull() & F.col("next").isNotNull(), inner, 0.3 * (1 - F.abs(2 * t - 1))),
        (F.col("prev").isNull(), V.add(first, V.scale(out_left, spacing * (F.col("first.at") - at))), F.lit(0.1)),
        (F.lit(True), V.add(last, V.scale(out_right, spacing * (at - F.col("last.at")))), F.lit(0.1)),
    ]
    return _emit(rows, keys, pos, cases)


def _span_inner(rows: DataFrame, name: str, left: V.Vec, right: V.Vec, span: Column, t: Column, spacing: float) -> tuple[DataFrame, V.Vec]:
    """Stretched and bent when the ends are closer than 0.7 of the expected span, else linear."""
    seg = V.sub(right, left)
    rows, d = V.staged(rows, f"{name}_d", _unit(seg, 1e-10))
    rows, side = V.staged(rows, f"{name}_s", V.cross(d, V.const(0, 0, 1)))
    rows, side = V.staged(rows, f"{name}_p", V.pick(V.norm(side) < 1e-6, V.cross(d, V.const(1, 0, 0)), side))
    rows, side = V.staged(rows, f"{name}_u", _unit(side, 1e-10))
    rows = rows.withColumns({f"{name}_e": span * spacing, f"{name}_t": t})
    expected, at = F.col(f"{name}_e"), F.col(f"{name}_t")
    bent = V.add(V.add(left, V.scale(d, expected * at)), V.scale(side, 2.0 * F.sin(at * math.pi)))
    straight = V.add(V.scale(left, 1 - at), V.scale(right, at))
    return V.staged(rows, name, V.pick(V.norm(seg) < expected * 0.7, bent, straight))


def fill_gaps_span(points: DataFrame, keys: Sequence[str], pos: str, spacing: float = 5.9) -> DataFrame:
    """Span-aware completion: each gap is filled once from its resolved ends.

    Leading positions step along x; trailing ones follow the last filled step.
    """
    rows = _with_ends(points, keys, pos)
    at = F.col(pos)
    here, left, right = V.vec(), V.vec("prev"), V.vec("next")
    span = F.col("next.at") - F.col("prev.at")
    first, last, before = V.vec("first"), V.vec("last"), V.vec("before_last")
    end_span = F.col("last.at") - F.col("before_last.at")
    rows, inner = _span_inner(rows, "in", left, right, span, (at - F.col("prev.at")) / span, spacing)
    rows, near_end = _span_inner(rows, "end", before, last, end_span, (end_span - 1) / end_span, spacing)
    # Without an earlier resolved point the position before the last is a leading one.
    lone = F.col("before_last").isNull()
    penultimate = V.pick(lone, V.add(last, V.const(spacing, 0, 0)), V.pick(end_span == 1, before, near_end))
    rows, penultimate = V.staged(rows, "pen", penultimate)
    rows, onward = V.staged(rows, "on", V.pick(F.col("last.at") > 0, _unit(V.sub(last, penultimate), 1e-10), V.const(1, 0, 0)))
    cases = [
        (V.resolved(here), here, F.lit(1.0)),
        (F.col("first").isNull(), (F.lit(0.0), F.lit(0.0), at * F.lit(spacing)), F.lit(0.0)),
        (F.col("prev").isNotNull() & F.col("next").isNotNull(), inner, 0.3 * (1 - F.abs(2 * F.col("in_t") - 1))),
        (F.col("prev").isNull(), V.add(first, V.scale(V.const(1, 0, 0), spacing * (F.col("first.at") - at))), F.lit(0.1)),
        (F.lit(True), V.add(last, V.scale(onward, spacing * (at - F.col("last.at")))), F.lit(0.1)),
    ]
    return _emit(rows, keys, pos, cases)


# ---------------------------------------------------------------- ranks and smoothing


def rank01(df: DataFrame, keys: Sequence[str], value: str, name: str = "rank01", higher: bool = True, flat: float = 1e-12) -> DataFrame:
    """Tie-averaged rank scaled to [0, 1]; 0.5 where the group is constant or single."""
    ranked = order.with_average_rank(df, keys, value, "_rank")
    constant = (F.col("_rank_n") <= 1) | (F.col("_rank_span") <= flat)
    score = F.when(constant, F.lit(0.5)).otherwise((F.col("_rank") - 1) / (F.col("_rank_n") - 1))
    return ranked.withColumn(name, score if higher else 1 - score).drop("_rank", "_rank_n", "_rank_span")


def relative_confidence(df: DataFrame, keys: Sequence[str], value: str, name: str = "relative_confidence") -> DataFrame:
    """0.25 + 0.75 times the scaled rank; a constant group gives 0.625."""
    return rank01(df, keys, value, "_r01", flat=1e-8).withColumn(name, 0.25 + 0.75 * F.col("_r01")).drop("_r01")


def smooth(df: DataFrame, keys: Sequence[str], pos: str, value: str, weights: Mapping[int, float | Column], name: str, length: str = "length") -> DataFrame:
    """Weighted sum over offsets; positions beyond a chain end take the end's value."""
    ends = order.attach(df, keys, F.min_by(value, pos).alias("_head"), F.max_by(value, pos).alias("_tail"))
    near = order.at_offsets(ends, keys, pos, [value], weights)
    total = F.lit(0.0)
    for offset, weight in weights.items():
        at = F.col(pos) + offset
        v = F.when(at < 0, F.col("_head")).when(at >= F.col(length), F.col("_tail")).otherwise(F.col(order.offset_name(offset))[value])
        total = total + v * weight
    return near.withColumn(name, total).select(*df.columns, name)


def gaussian_weights(radius: int, sigma: float) -> dict[int, float]:
    raw = {o: math.exp(-0.5 * (o / sigma) ** 2) for o in range(-radius, radius + 1)}
    size = sum(raw.values())
    return {o: w / size for o, w in raw.items()}


def uniform_weights(window: int, length: Column) -> dict[int, Column]:
    """Centred mean over min(window, length) positions; even sizes reach one further back."""
    size = F.least(F.lit(window), length)
    back = F.floor(size / 2)
    return {
        o: F.when((F.lit(o) >= -back) & (F.lit(o) <= size - back - 1), 1.0 / size).otherwise(0.0)
        for o in range(-(window // 2), window - window // 2)
    }


def center(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    return order.attach(df, keys, F.avg(value).alias("_mean")).withColumn(name, F.col(value) - F.col("_mean")).drop("_mean")


def scatter_average(df: DataFrame, keys: Sequence[str], pos: str, value: str, name: str) -> DataFrame:
    """Mean of the values of the two steps that touch a position (step i joins i and i + 1)."""
    near = order.at_offsets(df, keys, pos, [value], [-1])
    before = F.col("nm1")[value]
    touching = F.col(value).isNotNull().cast("int") + before.isNotNull().cast("int")
    total = F.coalesce(F.col(value), F.lit(0.0)) + F.coalesce(before, F.lit(0.0))
    return near.withColumn(name, F.when(touching > 0, total / touching).otherwise(0.0)).drop("nm1")


# ---------------------------------------------------------------- splits, samples, representatives


def grouped_temporal_split(df: DataFrame, date: str, group: str, calibration: float = 0.15, validation: float = 0.20) -> DataFrame:
    """Chronological bands by cumulative count; a group takes its latest band and loses older members.

    Only the per-date counts are ordered.
    """
    per_date = df.groupBy(date).agg(F.count(F.lit(1)).alias("_n"))
    running = F.sum("_n").over(Window.orderBy(date).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("_n").over(Window.partitionBy())
    band = F.when(running <= total * (1 - calibration - validation), 0).when(running <= total * (1 - validation), 1).otherwise(2)
    banded = df.join(per_date.select(date, band.alias("_band")), date)
    latest = banded.groupBy(group).agg(F.max("_band").alias("_latest"))
    split = F.element_at(F.array(F.lit("train"), F.lit("calibration"), F.lit("validation")), F.col("_band") + 1)
    return banded.join(latest, group).where(F.col("_band") == F.col("_latest")).withColumn("split", split).drop("_band", "_latest")


def temporal_split(df: DataFrame, date: str, calibration: float, validation: float) -> DataFrame:
    """Three-way split by row share; a date that straddles a boundary goes wholly to the later split.

    Works on per-date counts: a boundary falls on the first row of the date that holds it.
    """
    per_date = df.groupBy(date).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("_n").over(Window.partitionBy())
    start = F.sum("_n").over(upto) - F.col("_n")
    train_raw = F.least(F.greatest(F.bround(total * (1 - calibration - validation)), F.lit(1)), total - 2)
    cal_raw = F.least(F.greatest(F.bround(total * (1 - validation)), train_raw + 1), total - 1)
    dated = per_date.select(date, "_n", start.alias("_start"), train_raw.alias("_train"), cal_raw.alias("_cal"))
    holds = lambda c: (F.col("_start") <= F.col(c)) & (F.col(c) < F.col("_start") + F.col("_n"))
    every = Window.partitionBy()
    # A boundary never moves before the second row, nor the calibration one up to the train one.
    train_end = F.greatest(F.max(F.when(holds("_train"), F.col("_start"))).over(every), F.lit(1))
    bounds = dated.withColumn("_t", train_end).withColumn(
        "_c", F.greatest(F.max(F.when(holds("_cal"), F.col("_start"))).over(every), F.col("_t") + 1)
    )
    labelled = bounds.select(date, F.when(F.col("_start") < F.col("_t"), "train").when(F.col("_start") < F.col("_c"), "calibration").otherwise("validation").alias("split"))
    return df.join(labelled, date)


def spaced_sample(df: DataFrame, keys: Sequence[str], by: Sequence[str], bucket: Column, n: int) -> DataFrame:
    """n evenly spaced rows of each ordered key: positions round-half-even(i (N - 1) / (n - 1))."""
    placed = order.positions(df, keys, by, bucket, total="_total")
    slots = placed.select(*keys, "_total").distinct()
    wanted = slots.select(
        *keys, F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * ((F.col("_total") - 1) / F.lit(n - 1))).cast("long"))).alias("pos")
    ).distinct()
    return placed.join(wanted, [*keys, "pos"], "left_semi").drop("_total")


def representatives(df: DataFrame, group: str, date: str, key: str) -> DataFrame:
    """Newest member (smallest id on ties) of each duplicate group, for every member.

    ``date`` may be of any ordered type; a missing one is the oldest.
    """
    first = df.groupBy(group, date).agg(F.min(key).alias("_first"), F.count(F.lit(1)).alias("_n"))
    # max_by passes over missing dates; where all are missing there is one row
    newest = F.coalesce(F.max_by("_first", date), F.min("_first")).alias("representative")
    return order.join_on(df, first.groupBy(group).agg(newest, F.sum("_n").alias("members")), [group])


def tertiles(df: DataFrame, value: str, key: str, groups: int = 3) -> DataFrame:
    """Equal-width groups of the tie-broken rank: least(g - 1, floor(g (r - 1) / (N - 1)))."""
    placed = order.positions(df, [], [value, key], order.order_bucket(F.col(value)), total="_total")
    number = F.least(F.lit(groups - 1), F.floor(F.lit(groups) * F.col("pos") / (F.col("_total") - 1)))
    return placed.withColumn("tertile", number.cast("int")).drop("pos", "_total")
