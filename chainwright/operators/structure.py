"""Structure-versus-structure measures, superposition, contacts and source blending.

Superposition is solved from sums that combine map-side: only eighteen numbers
per pair of structures reach the solver, whatever the chain length, so no chain
is collected.  ``pairs`` frames carry keys, pos, px..pz (moving) and qx..qz.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainwright.functions import vectors as V
from chainwright.functions.sequence import soft_label
from chainwright.operators import order, windows
from chainwright.operators.joins import radius_pairs
from chainwright.operators.priors import nll_lookup
from chainwright.session import discard, durable, stash

COMPLEMENTS = ("AU", "UA", "GC", "CG", "GU", "UG")  # fixed pair types
LDDT_THRESHOLDS = (0.5, 1.0, 2.0, 4.0)  # fixed thresholds


def _p() -> V.Vec:
    return tuple(F.col(f"p{a}") for a in "xyz")


def _q() -> V.Vec:
    return tuple(F.col(f"q{a}") for a in "xyz")


# ---------------------------------------------------------------- deviation and accuracy


def rmsd(pairs: DataFrame, keys: Sequence[str], least: int = 3) -> DataFrame:
    """Superposed deviation over shared resolved positions, NULL below ``least``."""
    shared = V.resolved(_p()) & V.resolved(_q())
    centred = order.attach(pairs, keys, *[F.avg(F.when(shared, F.col(f"{s}{a}"))).alias(f"_m{s}{a}") for s in "pq" for a in "xyz"])
    p = tuple(F.col(f"p{a}") - F.col(f"_mp{a}") for a in "xyz")
    q = tuple(F.col(f"q{a}") - F.col(f"_mq{a}") for a in "xyz")
    rows = centred.select(*keys, *[c.alias(f"u{i}") for i, c in enumerate(p)], *[c.alias(f"v{i}") for i, c in enumerate(q)])
    sums = V.pair_statistics(tuple(F.col(f"u{i}") for i in range(3)), tuple(F.col(f"v{i}") for i in range(3)))
    totals = rows.groupBy(*keys).agg(*[c.alias(n) for n, c in sums.items()])
    return V.with_rmsd(totals, "rmsd", least).select(*keys, "n", "rmsd")


def lddt_pairs(predicted: DataFrame, reference: DataFrame, target: str, structure: str, radius: float = 15.0, thresholds: Sequence[float] = LDDT_THRESHOLDS) -> DataFrame:
    """Preserved share of each native pair within ``radius``; a missing predicted point preserves none.

    ``predicted`` holds one row per position (NULL when missing) with target and structure.
    """
    native = radius_pairs(reference, reference, [target], radius).withColumnRenamed("distance", "native")
    side = lambda s, keys: predicted.select(*keys, structure, F.col("pos").alias(s), *[F.col(a).alias(f"{a}{s}") for a in "xyz"])
    joined = native.join(side("i", [target]), [target, "i"]).join(side("j", []), [structure, "j"], "left")
    distance = V.norm(V.sub(tuple(F.col(f"{a}i") for a in "xyz"), tuple(F.col(f"{a}j") for a in "xyz")))
    error = F.abs(distance - F.col("native"))
    kept = sum((F.coalesce((error < t).cast("double"), F.lit(0.0)) for t in thresholds), F.lit(0.0)) / len(thresholds)
    return joined.select(target, structure, "i", "j", kept.alias("kept"))


def lddt(predicted: DataFrame, reference: DataFrame, target: str, structure: str, radius: float = 15.0) -> DataFrame:
    """Mean over positions of the preserved share, the mean over pairs, and counts."""
    pairs = lddt_pairs(predicted, reference, target, structure, radius)
    ends = pairs.select(target, structure, F.explode(F.array("i", "j")).alias("pos"), "kept", (F.lit(1)).alias("_one"))
    per_position = ends.groupBy(target, structure, "pos").agg(F.avg("kept").alias("_v"), F.sum("kept").alias("_s"), F.count("kept").alias("_n"))
    return per_position.groupBy(target, structure).agg(
        F.avg("_v").alias("lddt"), (F.sum("_s") / F.sum("_n")).alias("lddt_pair"), (F.sum("_n") / 2).cast("long").alias("pairs"), F.count(F.lit(1)).alias("scored")
    )


def lddt_per_position(predicted: DataFrame, reference: DataFrame, target: str, structure: str, radius: float = 15.0) -> DataFrame:
    pairs = lddt_pairs(predicted, reference, target, structure, radius)
    ends = pairs.select(structure, F.explode(F.array("i", "j")).alias("pos"), "kept")
    return ends.groupBy(structure, "pos").agg(F.avg("kept").alias("lddt"))


def local_accuracy(pairs: DataFrame, predicted: DataFrame, reference: DataFrame, target: str, structure: str, widths: Sequence[int] = (9, 15, 31)) -> DataFrame:
    """Deviation, lDDT and mean windowed deviations in one row per structure."""
    keys = [target, structure]
    out = rmsd(pairs, keys).drop("n").join(lddt(predicted, reference, target, structure), keys, "left")
    for width in widths:
        window = windows.sliding_rmsd(pairs, keys, "pos", width).groupBy(*keys).agg(F.avg("window_rmsd").alias(f"sw_rmsd_{width}"))
        out = out.join(window, keys, "left")
    return out


def geometry_metrics(points: DataFrame, keys: Sequence[str], r_min: float, a: float, b: float, expected: float) -> DataFrame:
    """Clashes per position, backbone deviation, size error against a * L ** b, and kinks."""
    sizes = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("length"), F.sqrt(F.var_pop("x") + F.var_pop("y") + F.var_pop("z")).alias("_rg")
    )
    clashes = radius_pairs(points, points, keys, r_min, 2).where(F.col("distance") < r_min).groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    dev = windows.backbone_dev(points, keys, "pos", expected)
    kinks = windows.kink_fraction(points, keys, "pos")
    keys = list(keys)
    joined = sizes.join(clashes, keys, "left").join(dev, keys, "left").join(kinks, keys, "left")
    return joined.select(
        *keys,
        (F.coalesce("_c", F.lit(0)) / F.col("length")).alias("clash_per_res"),
        "bb_dev",
        F.abs(F.col("_rg") - a * F.pow(F.col("length").cast("double"), F.lit(b))).alias("rg_err"),
        F.coalesce("sharp_kinks", F.lit(0.0)).alias("sharp_kinks"),
    )


def drift(refined: DataFrame, raw: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and largest displacement of refined points."""
    other = raw.select(*keys, "pos", *[F.col(a).alias(f"{a}0") for a in "xyz"])
    moved = refined.join(other, [*keys, "pos"]).withColumn("_d", V.norm(V.sub(V.vec(), V.vec(suffix="0"))))
    return moved.groupBy(*keys).agg(F.avg("_d").alias("mean_drift"), F.max("_d").alias("max_drift"))


# ---------------------------------------------------------------- superposition


def fit(pairs: DataFrame, keys: Sequence[str], active: Column | None = None) -> DataFrame:
    """Attach aligned points ax..az of the moving structure; NULL below three shared points."""
    use = active if active is not None else F.lit(True)
    p = tuple(F.when(use, c) for c in _p())
    sums = V.pair_statistics(p, _q())
    totals = pairs.groupBy(*keys).agg(*[F.coalesce(c, F.lit(0.0)).alias(k) if k != "n" else c.alias("n") for k, c in sums.items()])
    solved = V.with_rotation(totals.where(F.col("n") >= 3), "_m").select(*keys, F.col("n").alias("fitted"), "_m")
    m = lambda i: F.get("_m", F.lit(i))
    rotated = [sum((m(3 * r + c) * _p()[c] for c in range(3)), m(9 + r)).alias(f"a{'xyz'[r]}") for r in range(3)]
    joined = pairs.join(solved, list(keys), "left")
    return joined.select(*pairs.columns, "fitted", *rotated)


def robust_superpose(pairs: DataFrame, keys: Sequence[str], anchor: str | None = None, trim: float = 0.8, iterations: int = 3, whole: int = 1024) -> DataFrame:
    """Superposition with repeated trimming of the largest residuals.

    Adds ax..az, residual and inlier.  ``anchor`` names a boolean column of positions
    to fit on; pairs with fewer than three anchors use all shared positions.  Keys of at most
    ``whole`` positions are gathered into a row and pass all rounds there; for larger ones each
    round is a few jobs, written to the checkpoint folder, so the plan stays one round deep.
    """
    keys = list(keys)
    shared = V.resolved(_p()) & V.resolved(_q())
    base = shared & F.coalesce(F.col(anchor), F.lit(False)) if anchor else shared
    rows = stash(pairs.withColumns({"_shared": shared, "_base": base}), "pairs")
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"))
    large = stash(sizes.where(F.col("_k") > whole).drop("_k"), "large")
    if large.isEmpty():
        return durable(_superposed_in_row(rows, keys, trim, iterations))
    some = _superposed_in_row(order.join_on(rows, large, keys, "left_anti"), keys, trim, iterations)
    others = _superposed_by_rounds(order.join_on(rows, large, keys, "left_semi"), keys, trim, iterations)
    return durable(some.unionByName(others))


def _superposed_in_row(rows: DataFrame, keys: Sequence[str], trim: float, iterations: int) -> DataFrame:
    """All rounds of ``robust_superpose`` inside the row of a key, from one shuffle."""
    kept = [c for c in rows.columns if c not in ("_shared", "_base")]
    start = F.when(F.size(F.filter("_r", lambda r: r["_base"])) >= 3, F.transform("_r", lambda r: r["_base"])).otherwise(F.transform("_r", lambda r: r["_shared"]))
    state = rows.groupBy(*keys).agg(F.collect_list(F.struct(*rows.columns)).alias("_r"))
    state = state.withColumn("_b", start)
    state = state.withColumn("_on", F.col("_b"))
    axes = [f"{s}{a}" for s in "pq" for a in "xyz"]
    for _ in range(iterations):
        used = F.filter(F.transform("_r", lambda r, i: F.struct(F.get("_on", i).alias("on"), *[r[c].cast("double").alias(c) for c in axes])), lambda r: r["on"])
        side = lambda s, r: tuple(r[f"{s}{a}"] for a in "xyz")
        terms = lambda r: V.pair_statistics(side("p", r), side("q", r), total=lambda c: c)  # noqa: E731, B023
        zero = F.struct(*[F.lit(0).cast("long" if k == "n" else "double").alias(k) for k in terms(F.struct(*[F.lit(0.0).alias(c) for c in axes]))])
        add = lambda t, r: F.struct(*[(t[k] + F.coalesce(c, F.lit(0).cast("long") if k == "n" else F.lit(0.0))).alias(k) for k, c in terms(r).items()])  # noqa: E731, B023
        summed = state.withColumn("_s", F.aggregate(used, zero, add))
        names = summed.schema["_s"].dataType.fieldNames()
        solved = V.with_rotation(summed.select("*", "_s.*").drop("_s"), "_m").drop(*names, "_s")
        # a key of fewer than three points to fit on has no rotation
        state = solved.withColumn("_m", F.when(F.size(F.filter("_on", lambda x: x)) >= 3, F.col("_m")))
        m = lambda i: F.get("_m", F.lit(i))
        point = lambda r: F.struct(*[sum((m(3 * k + c) * r[f"p{a}"] for c, a in enumerate("xyz")), m(9 + k)).alias(f"a{'xyz'[k]}") for k in range(3)])  # noqa: E731, B023
        state = state.withColumn("_a", F.transform("_r", point))
        away = lambda r, i: V.norm(tuple(F.get("_a", i)[f"a{a}"] - r[f"q{a}"] for a in "xyz"))
        state = state.withColumn("_d", F.transform("_r", away))
        fitted = F.array_sort(F.filter("_d", lambda d, i: F.get("_on", i) & d.isNotNull()))
        state = state.withColumn("_f", fitted)
        at = (F.size("_f") - 1) * F.lit(float(trim))
        low, high = F.get("_f", F.floor(at).cast("int")), F.get("_f", F.ceil(at).cast("int"))
        state = state.withColumn("_cut", F.when(F.size("_f") > 0, low + (high - low) * (at - F.floor(at))))
        state = state.withColumn("_next", F.transform("_b", lambda b, i: F.coalesce(b & (F.get("_d", i) <= F.col("_cut")), F.lit(False))))
        moves = (F.size("_f") > 3) & (F.size(F.filter("_next", lambda x: x)) >= 3)
        state = state.withColumn("_on", F.when(moves, F.col("_next")).otherwise(F.col("_on"))).select(*keys, "_r", "_b", "_on", "_a", "_d")
    whole = F.transform("_r", lambda r, i: F.struct(*[r[c].alias(c) for c in kept], F.get("_on", i).alias("inlier"), *[F.get("_a", i)[f"a{a}"].alias(f"a{a}") for a in "xyz"], F.get("_d", i).alias("residual")))
    return state.select(F.inline(whole))


def _superposed_by_rounds(rows: DataFrame, keys: Sequence[str], trim: float, iterations: int) -> DataFrame:
    """``robust_superpose`` for keys of any length, a few jobs a round."""
    rows = order.attach(rows, keys, F.count_if("_base").alias("_nb"))
    rows = rows.withColumn("_base", F.when(F.col("_nb") >= 3, F.col("_base")).otherwise(F.col("_shared"))).drop("_nb", "_shared")
    state = durable(rows.withColumn("inlier", F.col("_base")))
    for _ in range(iterations):
        fitted = fit(state.select(*rows.columns, "inlier"), keys, F.col("inlier"))
        aligned = tuple(F.col(f"a{a}") for a in "xyz")
        fitted = fitted.withColumn("residual", V.norm(V.sub(aligned, _q()))).drop("fitted")
        cut = order.percentiles(fitted.where("inlier"), keys, "residual", {"_cut": trim}).withColumnRenamed("n", "_n")
        joined = order.join_on(fitted, cut, keys, "left").withColumn("_next", F.col("_base") & (F.col("residual") <= F.col("_cut")))
        counted = order.attach(joined, keys, F.count_if("_next").alias("_nn"))
        moves = (F.col("_n") > 3) & (F.col("_nn") >= 3)
        moved = counted.withColumn("inlier", F.when(moves, F.col("_next")).otherwise(F.col("inlier")))
        state = durable(moved.drop("_cut", "_n", "_nn", "_next"))
    return state.drop("_base")


def superposition_summary(aligned: DataFrame, keys: Sequence[str]) -> DataFrame:
    return aligned.groupBy(*keys).agg(
        F.sqrt(F.avg(F.when(F.col("inlier"), F.col("residual") * F.col("residual")))).alias("alignment_rmsd"),
        F.avg(F.col("inlier").cast("double")).alias("inlier_fraction"),
    )


def rna_d0(length: Column) -> Column:
    """Length scale of the nucleic-acid similarity score (published piecewise values)."""
    n = length.cast("double")
    return (
        F.when(n < 12, 0.3).when(n < 16, 0.4).when(n < 20, 0.5).when(n < 24, 0.6).when(n < 30, 0.7).otherwise(0.6 * F.sqrt(n - 0.5) - 2.5)
    )


def tm_fixed(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Similarity score under fixed correspondence and one global fit: a lower bound of a searched score."""
    sized = order.attach(pairs, keys, F.count_if(V.resolved(_q())).alias("_len"))
    fitted = fit(sized, keys)
    distance = V.norm(V.sub(tuple(F.col(f"a{a}") for a in "xyz"), _q()))
    ratio = distance / rna_d0(F.col("_len"))
    return fitted.groupBy(*keys).agg((F.coalesce(F.sum(1 / (1 + ratio * ratio)), F.lit(0.0)) / F.max("_len")).alias("tm"))


def score_or_default(scores: DataFrame, keys: Sequence[str], value: str, default: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Keep every target: failed scores become the default, and are listed with scope and reason."""
    failed = F.col(value).isNull() | F.isnan(value)
    kept = scores.withColumn(value, F.when(failed, F.lit(default)).otherwise(F.col(value))).withColumn("failed", failed)
    failures = scores.where(failed).select(*keys, F.lit("score").alias("scope"), F.lit("fewer than three shared points").alias("reason"))
    return kept, failures


# ---------------------------------------------------------------- contacts


def pair_like(points: DataFrame, keys: Sequence[str], letter: str, distance: float = 10.5, tolerance: float = 2.5, separation: int = 4, whole: int = 512) -> DataFrame:
    """One-to-one complementary contacts, greedily by (deviation, i, j).

    Keys of at most ``whole`` points are gathered into a row, which finds its contacts and passes
    through them, without a join of points or a job per round.  For larger ones the sequential
    rule is run as rounds of local minima: a contact that is the best of both its ends is what the
    greedy pass would take, so all such contacts are taken at once and their ends removed.  Rounds
    stop when no contact is left.
    """
    keys = list(keys)
    known = points.select(*keys, "pos", "x", "y", "z", letter)
    known = known.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in known.columns]))
    sizes = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > whole).select(*keys)
    if sizes.isEmpty():
        return stash(_contacts_in_row(known, keys, letter, distance, tolerance, separation), "contacts")
    sizes = stash(sizes, "large")
    taken = [stash(_contacts_in_row(known.join(sizes, keys, "left_anti"), keys, letter, distance, tolerance, separation), "contacts")]
    many = known.join(sizes, keys, "left_semi")
    near = radius_pairs(many, many, keys, distance + tolerance, separation, carry=[letter])
    deviation = F.abs(F.col("distance") - distance)
    large = stash(near.where(F.concat(f"{letter}_i", f"{letter}_j").isin(*COMPLEMENTS)).where(deviation <= tolerance).select(*keys, deviation.alias("deviation"), "i", "j"), "contacts")
    while not large.isEmpty():
        best = F.min(F.struct("deviation", "i", "j")).alias("_b")
        ends = large.select(*keys, "deviation", "i", "j", F.explode(F.array("i", "j")).alias("_end")).groupBy(*keys, "_end").agg(best)
        mutual = stash(ends.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == 2).select(*keys, "_b.deviation", "_b.i", "_b.j"), "mutual")
        taken.append(mutual)
        used = mutual.select(*keys, F.explode(F.array("i", "j")).alias("_end"))
        free = order.join_on(large, used.withColumnRenamed("_end", "i"), [*keys, "i"], "left_anti")
        large = stash(order.join_on(free, used.withColumnRenamed("_end", "j"), [*keys, "j"], "left_anti"), "contacts")
    return reduce(DataFrame.unionByName, taken)


def _contacts_in_row(points: DataFrame, keys: Sequence[str], letter: str, distance: float, tolerance: float, separation: int) -> DataFrame:
    """Contacts of each key and the greedy pass through them, inside the row that its points are gathered into."""
    axes = [F.col(a).cast("double").alias(a) for a in "xyz"]
    listed = points.groupBy(*keys).agg(F.collect_list(F.struct("pos", *axes, F.col(letter).alias("c"))).alias("_r"))
    position = points.schema["pos"].dataType
    fields = [*listed.select(*keys).schema.fields, T.StructField("deviation", T.DoubleType()), T.StructField("i", position), T.StructField("j", position)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, ends = batch["_r"].flatten(), np.cumsum(np.array(batch["_r"].value_lengths()))
            pos, x, y, z = (np.array(flat.field(c)) for c in ("pos", "x", "y", "z"))
            kinds = flat.field("c").dictionary_encode()
            names, kind = kinds.dictionary.to_pylist(), np.array(kinds.indices)
            fits = np.array([[a + b in COMPLEMENTS for b in names] for a in names], bool).reshape(len(names), len(names))
            rows, got = [], []
            for row, (start, end) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
                at, n = pos[start:end], kind[start:end]
                sides = [v[start:end, None] - v[None, start:end] for v in (x, y, z)]
                with np.errstate(all="ignore"):
                    apart = np.sqrt(sides[0] * sides[0] + sides[1] * sides[1] + sides[2] * sides[2])
                    deviation = np.abs(apart - distance)
                    met = (at[None, :] - at[:, None] >= separation) & fits[n[:, None], n[None, :]] & (apart <= distance + tolerance) & (deviation <= tolerance)
                a, b = np.nonzero(met)
                d, a, b = deviation[a, b], at[a], at[b]
                best = np.lexsort((b, a, d))
                used = set()
                for e in zip(d[best].tolist(), a[best].tolist(), b[best].tolist(), strict=True):
                    if e[1] not in used and e[2] not in used:
                        used.update(e[1:])
                        rows.append(row)
                        got.append(e)
            columns = [batch[c].take(pa.array(rows, pa.int64())) for c in keys]
            number = flat.field("pos").type
            for k, kept in enumerate((pa.float64(), number, number)):
                columns.append(pa.array([e[k] for e in got], kept))
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return listed.mapInArrow(run, T.StructType(fields))


def pair_mask(points: DataFrame, contacts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mark the positions of ``points`` that take part in a contact."""
    ends = contacts.select(*keys, F.explode(F.array("i", "j")).alias("pos"), F.lit(True).alias("paired"))
    return points.join(ends, [*keys, "pos"], "left").withColumn("paired", F.coalesce("paired", F.lit(False)))


def contextual_angles(points: DataFrame, keys: Sequence[str], paired: str = "paired") -> DataFrame:
    """Local angles with their pairing context: own position for angles, either middle one for torsions."""
    angles = windows.local_angles(points, keys, "pos", extra=[paired])
    flags = points.select(*keys, (F.col("pos") - 1).alias("pos"), F.col(paired).alias("_after"))
    context = lambda c: F.when(c, "pair_like").otherwise("unpaired")
    return angles.join(flags, [*keys, "pos"], "left").select(
        *keys,
        "pos",
        paired,
        F.when(F.col("angle_valid"), F.col("angle")).alias("angle"),
        F.when(F.col("torsion_valid"), F.col("torsion")).alias("torsion"),
        context(F.col(paired)).alias("angle_context"),
        context(F.col(paired) | F.coalesce("_after", F.lit(False))).alias("torsion_context"),
    )


def geometry_nll(angles: DataFrame, keys: Sequence[str], angle_prior: DataFrame, torsion_prior: DataFrame) -> DataFrame:
    """Mean context-conditioned negative log likelihoods and the paired share."""
    scored = nll_lookup(angles, "angle", "angle_context", angle_prior, "angle_nll")
    scored = nll_lookup(scored, "torsion", "torsion_context", torsion_prior, "torsion_nll")
    return scored.groupBy(*keys).agg(
        F.avg("angle_nll").alias("angle_nll"), F.avg("torsion_nll").alias("torsion_nll"), F.avg(F.col("paired").cast("double")).alias("pair_like_fraction")
    )


# ---------------------------------------------------------------- blending of two sources
#
# ``aligned`` frames: keys, pos, length, qx..qz (template), ax..az (aligned partner),
# residual, t_conf, p_conf, t_support, p_support.


def disagreement(aligned: DataFrame, keys: Sequence[str], window: int = 15) -> DataFrame:
    """Window mean of the point distances between both sources."""
    rows = aligned.withColumn("disagreement", F.col("residual"))
    return windows.smooth(rows, keys, "pos", "disagreement", windows.uniform_weights(window, F.col("length")), "window_disagreement")


def disagreement_summary(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    keys = list(keys)
    plain = rows.groupBy(*keys).agg(F.avg("disagreement").alias("mean_point"), F.avg("window_disagreement").alias("mean_window"))
    return plain.join(order.percentiles(rows, keys, "window_disagreement", {"p90": 0.9}).drop("n"), keys).join(superposition_summary(rows, keys), keys)


def _mix(rows: DataFrame, alpha: Column) -> DataFrame:
    point = [((1 - alpha) * F.col(f"q{a}") + alpha * F.col(f"a{a}")).alias(a) for a in "xyz"]
    confidence = F.least(F.greatest((1 - alpha) * F.col("t_conf") + alpha * F.col("p_conf"), F.lit(0.01)), F.lit(1.0))
    return rows.select(*[c for c in rows.columns], *point, confidence.alias("confidence"))


def blend_heuristic(aligned: DataFrame, keys: Sequence[str], mode: str = "conservative") -> DataFrame:
    """Confidence-weighted blend with caps, smoothed, and the caps applied again."""
    rows = windows.relative_confidence(aligned, keys, "p_conf", "_pq")
    template = F.least(F.greatest(F.col("t_conf"), F.lit(0.01)), F.lit(1.0))
    rows = rows.withColumn("alpha", F.col("_pq") / (template + F.col("_pq")))
    reliable = F.col("t_support") & (F.col("t_conf") >= 0.5)
    far = F.col("residual") > 12.0

    def capped(alpha: Column) -> Column:
        if mode == "conservative":
            return (
                F.when(far & F.col("t_support"), 0.0)
                .when(far, 1.0)
                .when(reliable, F.least(alpha, F.lit(0.15)))
            )
        return F.when(far | ~F.col("t_support"), 1.0).otherwise(F.greatest(alpha, F.lit(0.7)))

    first = capped(F.col("alpha"))
    first = F.coalesce(first, F.when(~F.col("t_support"), 0.9).otherwise(F.col("alpha"))) if mode == "conservative" else first
    rows = rows.withColumn("alpha", first)
    rows = windows.smooth(rows, keys, "pos", "alpha", windows.gaussian_weights(2, 2 / 1.5), "_smooth")
    again = F.coalesce(capped(F.col("_smooth")), F.col("_smooth")) if mode == "conservative" else capped(F.col("_smooth"))
    return _mix(rows.withColumn("alpha", F.least(F.greatest(again, F.lit(0.0)), F.lit(1.0))).drop("_smooth", "_pq"), F.col("alpha"))


def blend_selective(
    rows: DataFrame, keys: Sequence[str], probability: str, threshold: float, margin: float = 0.15, least: int = 7, low: float = 0.5, high: float = 12.0
) -> DataFrame:
    """Patch confident runs of plausible disagreement with soft edges; chains without a run are left out."""
    confident = F.col(probability) >= threshold + margin
    marked = rows.withColumn("_switch", confident & F.col("window_disagreement").between(low, high))
    runs = windows.run_mask(marked, keys, "pos", "_switch", "length", least).withColumn("alpha", F.col("kept").cast("double"))
    patched = runs.where("kept").select(*keys).distinct()
    soft = windows.smooth(runs.join(patched, list(keys), "left_semi"), keys, "pos", "alpha", windows.gaussian_weights(4, 1.0), "_soft")
    alpha = F.least(F.greatest(F.col("_soft"), F.lit(0.0)), F.lit(1.0))
    return _mix(soft.withColumn("alpha", alpha).drop("_soft", "_switch"), F.col("alpha"))


def blend_oracle(rows: DataFrame, partner_better: Column) -> DataFrame:
    """Upper bound: per position the better source."""
    return _mix(rows.withColumn("alpha", F.when(partner_better, 1.0).otherwise(0.0)), F.col("alpha"))


def local_geometry(points: DataFrame, keys: Sequence[str], letter: str, expected: float, angle_prior: DataFrame, torsion_prior: DataFrame) -> DataFrame:
    """Per position: backbone deviation, angle and torsion scores, kink and pairing."""
    keys = list(keys)
    contacts = pair_like(points, keys, letter)
    marked = stash(pair_mask(points, contacts, keys), "marked")
    angles = stash(contextual_angles(marked, keys), "angles")
    scored = nll_lookup(angles, "angle", "angle_context", angle_prior, "angle_nll")
    scored = nll_lookup(scored, "torsion", "torsion_context", torsion_prior, "_tn")
    steps = windows.adjacent_distance(points, keys, "pos").select(*keys, (F.col("pos") - 1).alias("pos"), F.abs(F.col("distance") - expected).alias("_step"))
    scored = stash(scored.join(steps, [*keys, "pos"], "left"), "scored")
    scored = windows.scatter_average(scored, keys, "pos", "_step", "bb_dev")
    scored = windows.scatter_average(scored, keys, "pos", "_tn", "torsion_nll")
    return scored.select(
        *keys,
        "pos",
        "bb_dev",
        F.coalesce("angle_nll", F.lit(0.0)).alias("angle_nll"),
        "torsion_nll",
        F.coalesce((F.degrees("angle") < 70).cast("double"), F.lit(0.0)).alias("sharp_kink"),
        F.col("paired").cast("double").alias("pair_like"),
    )


def gate_features(aligned: DataFrame, keys: Sequence[str], letter: str, expected: float, angle_prior: DataFrame, torsion_prior: DataFrame) -> DataFrame:
    """The routing features of each position of a (template, partner) pair.

    Each part is written before the next one is planned, so no plan holds several parts.
    """
    keys = list(keys)
    rows = windows.rank01(aligned, keys, "t_conf", "t_rank", flat=1e-8)
    rows = windows.rank01(rows, keys, "p_conf", "p_rank", flat=1e-8)
    rows = stash(windows.distance_to_false(rows, keys, "pos", "t_support"), "ranked")
    side = lambda s: aligned.select(*keys, "pos", letter, *[F.col(f"{s}{a}").alias(a) for a in "xyz"])
    for name, prefix in (("q", "t"), ("a", "p")):
        local = stash(local_geometry(side(name), keys, letter, expected, angle_prior, torsion_prior), "local")
        renamed = local.withColumnsRenamed({c: f"{prefix}_{c}" for c in ("bb_dev", "angle_nll", "torsion_nll", "sharp_kink", "pair_like")})
        rows = rows.join(renamed, [*keys, "pos"])
    return rows.select(
        *keys,
        "pos",
        "t_conf",
        "p_conf",
        "t_rank",
        "p_rank",
        F.col("t_support").cast("double").alias("t_supported"),
        "support_distance",
        F.least(F.col("residual") / 20.0, F.lit(2.0)).alias("source_disagreement"),
        *[f"{p}_{c}" for p in "tp" for c in ("bb_dev", "angle_nll", "torsion_nll", "sharp_kink", "pair_like")],
        *[(F.col(letter) == b).cast("double").alias(f"base_{b}") for b in "ACGU"],
        (F.log1p(F.col("length")) / 7.0).alias("log_length"),
    )


def make_examples(first: DataFrame, second: DataFrame, keys: Sequence[str], reference: str) -> DataFrame:
    """Per position errors of both sources against the native with the least joint error, and soft labels.

    ``first`` and ``second`` are superpositions of each source on each native:
    keys, reference, pos, residual.
    """
    keys = list(keys)
    joined = first.select(*keys, reference, "pos", F.col("residual").alias("t_error")).join(
        second.select(*keys, reference, "pos", F.col("residual").alias("p_error")), [*keys, reference, "pos"]
    )
    joint = joined.groupBy(*keys, reference).agg(F.avg(F.least("t_error", "p_error")).alias("_joint"))
    chosen = joint.groupBy(*keys).agg(F.min_by(reference, F.struct("_joint", reference)).alias(reference))
    label, weight = soft_label(F.col("t_error"), F.col("p_error"), 1.5, 5.0)
    resolved = F.col("t_error").isNotNull() & F.col("p_error").isNotNull()
    return joined.join(chosen, [*keys, reference]).select(
        *keys,
        reference,
        "pos",
        "t_error",
        "p_error",
        F.when(resolved, label).otherwise(0.5).alias("label"),
        F.when(resolved, weight).otherwise(0.0).alias("weight"),
        resolved.alias("resolved"),
    )


# ---------------------------------------------------------------- banks of candidates


def fold_families(vectors: DataFrame, bank: Sequence[str], cid: str, vector: str, threshold: float, block: int = 2048) -> DataFrame:
    """Complete-link families of each bank by cosine, numbered by first member; ids are distinct in a bank.

    Copies of a vector are one node. Only pairs within the threshold are kept, found in cells of about ``block`` by ``block``
    nodes, so a vector is sent as often as its bank has blocks. Files of a round go when those of the next are written. Each round merges all pairs of clusters that are nearest to each other, which gives the families of one merge at
    a time: a new link is the larger of the old ones, and is gone if one of them is. Ties go to the smaller first members.
    """
    bank = list(bank)
    size = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda s, x: s + x * x))
    rows = vectors.select(*bank, cid, F.transform(vector, lambda x: x.cast("double")).alias("_v"))
    nodes = stash(rows.groupBy(*bank, "_v").agg(F.min(cid).alias("_i")), "nodes")
    members = stash(order.join_on(rows, nodes, [*bank, "_v"]).select(*bank, cid, F.col("_i").alias("_l")), "members")

    units = nodes.select(*bank, "_i", F.transform("_v", lambda x: x / F.greatest(size, F.lit(1e-300))).alias("_u"))
    sized = order.attach(units, bank, F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_parts"))
    dealt = sized.withColumn("_at", F.pmod(F.xxhash64("_i"), F.col("_parts")).cast("int"))
    left = dealt.select(*bank, F.col("_i").alias("_a"), F.col("_u").alias("_ua"), F.col("_at").alias("_x"), F.explode(F.sequence("_at", F.col("_parts") - 1)).alias("_y"))
    right = dealt.select(*bank, F.col("_i").alias("_b"), F.col("_u").alias("_ub"), F.col("_at").alias("_y"), F.explode(F.sequence(F.lit(0), F.col("_at"))).alias("_x"))
    met = order.join_on(left, right, [*bank, "_x", "_y"]).where((F.col("_x") < F.col("_y")) | (F.col("_a") < F.col("_b")))
    dot = F.aggregate(F.zip_with("_ua", "_ub", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    far = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - dot)).alias("_d")
    pairs = met.select(*bank, F.greatest("_a", "_b").alias("_a"), F.least("_a", "_b").alias("_b"), far)
    edges = stash(pairs.where(F.col("_d") <= 1.0 - threshold), "edges")

    while True:
        ends = edges.select(*bank, F.explode(F.array("_a", "_b")).alias("_e"), F.struct("_d", "_a", "_b").alias("_p"))
        nearest = ends.groupBy(*bank, "_e").agg(F.min("_p").alias("_p"))
        mutual = nearest.groupBy(*bank, "_p").agg(F.count(F.lit(1)).alias("_n")).where("_n = 2")
        both = F.array(*[F.struct(F.col(f"_p.{c}").alias("_old"), F.col("_p._b").alias("_new")) for c in ("_a", "_b")])
        merged = stash(mutual.select(*bank, F.inline(both)), "merged")
        if merged.isEmpty():
            break

        def moved(df: DataFrame, column: str, to: str, here: DataFrame = merged) -> DataFrame:
            return order.join_on(df, here.select(*bank, F.col("_old").alias(column), F.col("_new").alias(to)), [*bank, column], "left")

        done = (members, edges, merged)
        members = stash(moved(members, "_l", "_to").select(*bank, cid, F.coalesce("_to", "_l").alias("_l")), "members")
        now = moved(moved(edges, "_a", "_ma"), "_b", "_mb").withColumns({"_na": F.coalesce("_ma", "_a"), "_nb": F.coalesce("_mb", "_b")})
        parts = F.when(F.col("_ma").isNull(), 1).otherwise(2) * F.when(F.col("_mb").isNull(), 1).otherwise(2)
        linked = now.where(F.col("_na") != F.col("_nb")).groupBy(*bank, F.greatest("_na", "_nb").alias("_a"), F.least("_na", "_nb").alias("_b"))
        edges = stash(linked.agg(F.max("_d").alias("_d"), F.count(F.lit(1)).alias("_n"), F.max(parts).alias("_k")).where("_n = _k").drop("_n", "_k"), "edges")
        discard(*done)

    first = members.groupBy(*bank, "_l").agg(F.min(cid).alias("_f"))
    bucket = order.order_bucket(F.col("_f")) if isinstance(first.schema["_f"].dataType, T.NumericType) else F.lit(0)
    numbered = order.positions(first, bank, ["_f"], bucket).select(*bank, "_l", F.col("pos").alias("family"))
    return order.join_on(members, numbered, [*bank, "_l"]).select(*bank, cid, "family")


def selected_similarity(vectors: DataFrame, selected: DataFrame, bank: Sequence[str], cid: str, vector: str) -> DataFrame:
    """Mean pairwise cosine of a selection, from the length of the summed unit vectors (no pairs)."""
    bank = list(bank)
    chosen = vectors.join(selected.select(*bank, cid), [*bank, cid], "left_semi")
    size = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    axes = chosen.select(*bank, cid, F.posexplode(F.transform(vector, lambda x: x / size)).alias("_k", "_u"))
    sums = axes.groupBy(*bank, "_k").agg(F.sum("_u").alias("_s"), F.count(F.lit(1)).alias("_n"))
    total = sums.groupBy(*bank).agg(F.sum(F.col("_s") * F.col("_s")).alias("_q"), F.max("_n").alias("selected"))
    n = F.col("selected")
    return total.select(*bank, "selected", F.when(n < 2, 1.0).otherwise((F.col("_q") - n) / (n * (n - 1))).alias("mean_similarity"))


# Fixed weights of the label-free quality score.
QUALITY_WEIGHTS = {
    "source_confidence": 0.25,
    "support_fraction": 0.20,
    "pair_like_fraction": 0.10,
    "angle_nll": 0.15,
    "torsion_nll": 0.10,
    "clash_per_res": 0.07,
    "bb_dev": 0.08,
    "sharp_kinks": 0.05,
}


def quality_score(features: DataFrame, target: Sequence[str], source: str, weights: Mapping[str, float] = QUALITY_WEIGHTS) -> DataFrame:
    """Weighted sum of scaled ranks; confidence is ranked inside its own source."""
    higher = ("source_confidence", "support_fraction", "pair_like_fraction")
    ids = [c for c in features.columns if c not in weights]
    # One ranking over (target, signal, group) in long form instead of one per signal.
    long = features.select(
        *ids,
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(n).alias("_signal"), (F.col(source) if n == "source_confidence" else F.lit("")).alias("_group"), F.col(n).cast("double").alias("_value"), F.lit(float(w)).alias("_w"))
                    for n, w in weights.items()
                ]
            )
        ),
    )
    ranked = windows.rank01(long, [*target, "_signal", "_group"], "_value", "_r")
    part = F.when(F.col("_signal").isin(*higher), F.col("_r")).otherwise(1 - F.col("_r")) * F.col("_w")
    return ranked.groupBy(*ids).agg(F.sum(part).alias("quality"))
