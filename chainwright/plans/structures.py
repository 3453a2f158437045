"""Registered queries: structure comparison, priors, contacts, blending and banks."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from chainwright.operators import priors, structure, topk
from chainwright.plans.chains import CENTRED, rmsd_sql, sliding_sql, sums_sql
from chainwright.plans.fixtures import (
    CHAIN, DENSE, PAIRS, PANEL, PTS, dense_points, event_chain, panel, reference_pairs, structure_points,
)
from chainwright.plans.registry import query
from chainwright.plans.rotation import ALIGNED, BLEND, DISAGREEMENT, SUMMARY, examples_sql, heuristic_sql, selective_sql, tm_sql
from chainwright.plans.summaries import rounded
from chainwright.session import durable



def references(t):
    return t.embeddings.groupBy(F.col("label").cast("long").alias("target")).agg(F.min("vec_id").alias("structure"))


def reference_points(t):
    chosen = references(t)
    return structure_points(t).join(chosen, ["target", "structure"], "left_semi").drop("structure")


RMSD = f"rsum AS (SELECT target, structure, {sums_sql()} FROM cen GROUP BY 1, 2), rm AS ({rmsd_sql('rsum', 'target, structure')})"


@query("st01_rmsd", f"WITH {PAIRS}, {CENTRED}, {RMSD} SELECT target, structure, n, round(rmsd, 5) AS rmsd FROM rm")
def _(t):
    table = structure.rmsd(reference_pairs(t), ["target", "structure"])
    return rounded(table, "rmsd", digits=5).select("target", "structure", "n", "rmsd")


LDDT = """rp AS (SELECT r.target, p.pos, p.x, p.y, p.z FROM ref r JOIN pts p ON p.structure = r.reference), nat AS (SELECT a.target, a.pos AS i, b.pos AS j, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS d FROM rp a JOIN rp b ON a.target = b.target AND a.pos < b.pos WHERE a.x IS NOT NULL AND b.x IS NOT NULL AND d <= 15),
 lp AS (SELECT n.target, a.structure, i, j, abs(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) - d) AS e, (CASE WHEN e < 0.5 THEN 1 ELSE 0 END + CASE WHEN e < 1 THEN 1 ELSE 0 END + CASE WHEN e < 2 THEN 1 ELSE 0 END + CASE WHEN e < 4 THEN 1 ELSE 0 END) / CAST(4 AS DOUBLE) AS kept
  FROM nat n JOIN pts a ON a.target = n.target AND a.pos = i JOIN pts b ON b.structure = a.structure AND b.pos = j),
 le AS (SELECT target, structure, i AS pos, kept FROM lp UNION ALL SELECT target, structure, j, kept FROM lp), lr AS (SELECT target, structure, pos, avg(kept) AS v FROM le GROUP BY 1, 2, 3),
 ld AS (SELECT target, structure, avg(v) AS lddt, CAST(count(*) AS BIGINT) AS scored FROM lr GROUP BY 1, 2), lq AS (SELECT structure, avg(kept) AS lddt_pair, CAST(count(*) AS BIGINT) AS pairs FROM lp GROUP BY 1)"""


@query("st02_lddt", f"WITH {PAIRS}, {LDDT} SELECT target, structure, round(lddt, 6) AS lddt, round(lddt_pair, 6) AS lddt_pair, pairs, scored FROM ld JOIN lq USING (structure)")
def _(t):
    return rounded(structure.lddt(structure_points(t), reference_points(t), "target", "structure"), "lddt", "lddt_pair")


def _window_mean(width: int) -> str:
    inner = sliding_sql(width).replace("wsum", f"wsum{width}").replace("wr AS", f"wr{width} AS").replace("FROM wr)", f"FROM wr{width})").replace("wp AS", f"wp{width} AS")
    return f"{inner}, m{width} AS (SELECT structure, avg(window_rmsd) AS v FROM wp{width} GROUP BY 1)"


@query(
    "st03_local_accuracy",
    f"""WITH {PAIRS}, {CENTRED}, {RMSD}, {LDDT}, {_window_mean(9)}, {_window_mean(15)}, {_window_mean(31)}
 SELECT target, structure, round(rmsd, 5) AS rmsd, round(lddt, 6) AS lddt, round(lddt_pair, 6) AS lddt_pair, round(m9.v, 5) AS sw_rmsd_9, round(m15.v, 5) AS sw_rmsd_15, round(m31.v, 5) AS sw_rmsd_31
 FROM rm LEFT JOIN ld USING (target, structure) LEFT JOIN lq USING (structure) LEFT JOIN m9 USING (structure) LEFT JOIN m15 USING (structure) LEFT JOIN m31 USING (structure)""",
)
def _(t):
    table = structure.local_accuracy(reference_pairs(t), structure_points(t), reference_points(t), "target", "structure")
    table = rounded(table, "rmsd", "sw_rmsd_9", "sw_rmsd_15", "sw_rmsd_31", digits=5)
    return rounded(table, "lddt", "lddt_pair").select("target", "structure", "rmsd", "lddt", "lddt_pair", "sw_rmsd_9", "sw_rmsd_15", "sw_rmsd_31")


@query(
    "st04_geometry_metrics",
    f"""WITH {DENSE}, c AS (SELECT a.structure, count(*) AS c FROM dense a JOIN dense b ON a.structure = b.structure AND b.pos - a.pos >= 2 WHERE sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) < 6 GROUP BY 1),
 s AS (SELECT structure, count(*) AS n, sqrt(var_pop(x)+var_pop(y)+var_pop(z)) AS rg FROM dense GROUP BY 1),
 l AS (SELECT *, lag(x) OVER w AS ax, lag(y) OVER w AS ay, lag(z) OVER w AS az, lead(x) OVER w AS cx, lead(y) OVER w AS cy, lead(z) OVER w AS cz FROM dense WINDOW w AS (PARTITION BY structure ORDER BY pos)),
 b AS (SELECT structure, avg(abs(sqrt((x-ax)*(x-ax)+(y-ay)*(y-ay)+(z-az)*(z-az)) - 5.9)) AS bb_dev, avg(CASE WHEN degrees(acos(((ax-x)*(cx-x)+(ay-y)*(cy-y)+(az-z)*(cz-z))/(sqrt((ax-x)*(ax-x)+(ay-y)*(ay-y)+(az-z)*(az-z))*sqrt((cx-x)*(cx-x)+(cy-y)*(cy-y)+(cz-z)*(cz-z))))) < 70 THEN 1.0 WHEN ax IS NOT NULL AND cx IS NOT NULL THEN 0.0 END) AS kinks FROM l GROUP BY 1)
 SELECT structure, round(coalesce(c, 0) / CAST(n AS DOUBLE), 6) AS clash_per_res, round(bb_dev, 6) AS bb_dev, round(abs(rg - 2.5 * pow(n, 0.4)), 6) AS rg_err, round(kinks, 6) AS sharp_kinks FROM s LEFT JOIN c USING (structure) JOIN b USING (structure)""",
)
def _(t):
    table = structure.geometry_metrics(dense_points(t), ["structure"], 6.0, 2.5, 0.4, 5.9)
    return rounded(table, "clash_per_res", "bb_dev", "rg_err", "sharp_kinks")


@query(
    "st09_drift",
    f"""WITH {DENSE} SELECT structure, round(avg(d), 6) AS mean_drift, round(max(d), 6) AS max_drift FROM (SELECT structure, sqrt((x*0.01)*(x*0.01)+(pos*0.1)*(pos*0.1)+(z*0.02)*(z*0.02)) AS d FROM dense) GROUP BY 1""",
)
def _(t):
    raw = dense_points(t)
    refined = raw.select("structure", "pos", (F.col("x") * 1.01).alias("x"), (F.col("y") + F.col("pos") * 0.1).alias("y"), (F.col("z") * 0.98).alias("z"))
    return rounded(structure.drift(refined, raw, ["structure"]), "mean_drift", "max_drift")


# ------------------------------------------------------------------ priors


def _hist_sql(source: str, lo: str, hi: str, bins: int, periodic: bool, by: str = "context") -> str:
    at = f"((g.bin + k - 3 + {bins}) % {bins})" if periodic else f"least(greatest(g.bin + k - 3, 0), {bins - 1})"
    return f"""cnt AS (SELECT {by}, CAST(least(floor((v - {lo}) / ({hi} - {lo}) * {bins}), {bins - 1}) AS BIGINT) AS bin, count(*) AS n FROM {source} WHERE v BETWEEN {lo} AND {hi} GROUP BY 1, 2),
 spine AS (SELECT {by}, b AS bin FROM (SELECT DISTINCT {by} FROM cnt), range({bins}) AS r(b)), c AS (SELECT s.{by}, s.bin, coalesce(n, 0) + 1 AS n FROM spine s LEFT JOIN cnt ON cnt.{by} = s.{by} AND cnt.bin = s.bin),
 sm AS (SELECT g.{by}, g.bin, sum(w * c.n) / 16 AS s FROM spine g, (VALUES (0, 1), (1, 2), (2, 3), (3, 4), (4, 3), (5, 2), (6, 1)) AS kern(k, w), c WHERE c.{by} = g.{by} AND c.bin = {at} GROUP BY 1, 2),
 pr AS (SELECT {by}, bin, s / sum(s) OVER (PARTITION BY {by}) AS p FROM sm), hp AS (SELECT {by}, bin, p, -ln(p) - min(-ln(p)) OVER (PARTITION BY {by}) AS nll FROM pr)"""


@query("ag20_histogram_prior", f"WITH v AS (SELECT event_type AS context, value AS v FROM events), {_hist_sql('v', '0', '200', 72, False)} SELECT context, CAST(bin AS INTEGER) AS bin, round(p, 6) AS probability, round(nll, 6) AS nll FROM hp")
def _(t):
    table = priors.histogram_prior(t.events, "value", 0.0, 200.0, 72, False, ["event_type"])
    return rounded(table.select(F.col("event_type").alias("context"), "bin", "probability", "nll"), "probability", "nll")


_TORS = f"""{CHAIN}, ctx AS (SELECT unnest(['global', CASE WHEN event_type = 'view' THEN 'pair_like' ELSE 'unpaired' END]) AS context, value / 100 * pi() - pi() AS v FROM chain)"""


def _context_prior(t):
    rows = event_chain(t).select((F.col("value") / 100 * math.pi - math.pi).alias("v"), "event_type")
    return priors.histogram_prior(priors.with_contexts(rows, F.col("event_type") == "view"), "v", -math.pi, math.pi, 72, True, ["context"])


@query("ag21_context_priors", f"WITH {_TORS}, {_hist_sql('ctx', '-pi()', 'pi()', 72, True)} SELECT context, CAST(bin AS INTEGER) AS bin, round(p, 6) AS probability, round(nll, 6) AS nll FROM hp")
def _(t):
    return rounded(_context_prior(t).select("context", "bin", "probability", "nll"), "probability", "nll")


@query(
    "sc08_nll_lookup",
    f"""WITH {_TORS}, {_hist_sql('ctx', '-pi()', 'pi()', 72, True)}, q AS (SELECT event_id, event_id % 1000 / CAST(160 AS DOUBLE) - 3.1 AS v FROM chain), a AS (SELECT *, (v + pi()) / (pi() + pi()) * 72 - 0.5 AS r, r - floor(r/72)*72 AS w FROM q)
 SELECT event_id, round((1 - (w - floor(w))) * l.nll + (w - floor(w)) * r2.nll, 6) AS nll FROM a JOIN hp l ON l.context = 'global' AND l.bin = floor(w) JOIN hp r2 ON r2.context = 'global' AND r2.bin = (CAST(floor(w) AS BIGINT) + 1) % 72""",
)
def _(t):
    rows = t.events.select("event_id", (F.col("event_id") % 1000 / 160.0 - 3.1).alias("v"), F.lit("global").alias("ctx"))
    return priors.nll_lookup(rows, "v", "ctx", _context_prior(t), "nll").select("event_id", F.round("nll", 6).alias("nll"))


@query(
    "sc10_pair_to_residue",
    """WITH m AS (SELECT vec_id, p // 8 AS i, p % 8 AS j, abs(CAST(embedding[p+1] AS DOUBLE)) * 4 AS v FROM embeddings, range(64) AS r(p)), a AS (SELECT vec_id, i AS pos, avg(v) AS r FROM m GROUP BY 1, 2), b AS (SELECT vec_id, j AS pos, avg(v) AS c FROM m GROUP BY 1, 2)
 SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(least(greatest((r + c) / 2, 0), 1), 6) AS confidence FROM a JOIN b USING (vec_id, pos)""",
)
def _(t):
    cells = t.embeddings.select("vec_id", F.posexplode("embedding").alias("p", "v")).select(
        "vec_id", F.floor(F.col("p") / 8).cast("int").alias("i"), (F.col("p") % 8).alias("j"), (F.abs(F.col("v").cast("double")) * 4).alias("value")
    )
    return rounded(priors.pair_to_residue(cells, ["vec_id"]), "confidence")


# ------------------------------------------------------------------ superposition and contacts


def lettered(t):
    return dense_points(t).withColumn("letter", F.substring(F.lit("ACGU"), F.pmod(F.col("structure") + F.col("pos"), F.lit(4)).cast("int") + 1, 1))


def source_pairs(t):
    """Every structure (partner) on its target's reference (template), with confidences and support."""
    points = lettered(t)
    chosen = references(t).withColumnRenamed("structure", "reference")
    template = points.join(chosen, (points.structure == chosen.reference) & (points.target == chosen.target)).select(
        chosen.target, "pos", *[F.col(a).alias(f"q{a}") for a in "xyz"]
    )
    s, pos = F.col("structure"), F.col("pos")
    return points.withColumnsRenamed({a: f"p{a}" for a in "xyz"}).join(template, ["target", "pos"]).select(
        "target",
        "structure",
        "pos",
        "letter",
        F.lit(21).cast("long").alias("length"),
        *[f"{c}{a}" for c in "pq" for a in "xyz"],
        ((s * 7 + pos * 3) % 10 / 10.0 + 0.05).alias("t_conf"),
        ((s * 3 + pos * 7) % 9 / 10.0 + 0.1).alias("p_conf"),
        ((s + pos) % 5 != 0).alias("t_support"),
        F.lit(True).alias("p_support"),
    )


def aligned_sources(t):
    anchored = source_pairs(t).withColumn("anchor", F.col("t_support") & (F.col("t_conf") >= 0.25))
    return structure.robust_superpose(anchored, ["structure"], "anchor")


@query("st07_robust_superpose", f"WITH {ALIGNED} SELECT structure, round(alignment_rmsd, 6) AS alignment_rmsd, round(inlier_fraction, 6) AS inlier_fraction FROM (SELECT structure, {SUMMARY} FROM al GROUP BY 1)")
def _(t):
    return rounded(structure.superposition_summary(aligned_sources(t), ["structure"]), "alignment_rmsd", "inlier_fraction")


@query("st18_tm_fixed", tm_sql(PAIRS))
def _(t):
    return rounded(structure.tm_fixed(reference_pairs(t), ["target", "structure"]), "tm")


_SOME = PAIRS.replace("pairs AS (", "pairs AS (SELECT * FROM (") + " WHERE p.structure % 10 <> p.pos AND (p.structure % 50 <> 7 OR p.pos < 3)))"


@query(
    "gv10_failures",
    f"""WITH {_SOME}, {CENTRED}, {RMSD} SELECT target, structure, round(coalesce(rmsd, 0), 6) AS rmsd, rmsd IS NULL AS failed, CASE WHEN rmsd IS NULL THEN 'score' END AS scope, CASE WHEN rmsd IS NULL THEN 'fewer than three shared points' END AS reason FROM rm""",
)
def _(t):
    scores = structure.rmsd(reference_pairs(t).where(F.col("structure") % 10 != F.col("pos")).where((F.col("structure") % 50 != 7) | (F.col("pos") < 3)), ["target", "structure"])
    kept, failures = structure.score_or_default(scores, ["target", "structure"], "rmsd")
    return rounded(kept.join(failures, ["target", "structure"], "left").select("target", "structure", "rmsd", "failed", "scope", "reason"), "rmsd")


@query("st05_pair_like")
def _(t):
    return rounded(structure.pair_like(lettered(t), ["structure"], "letter"), "deviation")


def _angle_priors(t):
    """Context priors estimated on the same chains: contacts, angles, then histograms."""
    points = lettered(t)
    marked = durable(structure.contextual_angles(structure.pair_mask(points, structure.pair_like(points, ["structure"], "letter"), ["structure"]), ["structure"]))
    both = lambda v, c: marked.where(F.col(v).isNotNull()).withColumn("context", F.explode(F.array(F.lit("global"), F.col(c))))
    angle = priors.histogram_prior(both("angle", "angle_context"), "angle", 0.0, math.pi, 72, False, ["context"])
    torsion = priors.histogram_prior(both("torsion", "torsion_context"), "torsion", -math.pi, math.pi, 72, True, ["context"])
    return marked, durable(angle), durable(torsion)


@query("st06_geometry_nll")
def _(t):
    angles, angle, torsion = _angle_priors(t)
    return rounded(structure.geometry_nll(angles, ["structure"], angle, torsion), "angle_nll", "torsion_nll", "pair_like_fraction")


@query(
    "st08_disagreement",
    f"""WITH {DISAGREEMENT} SELECT structure, round(mean_point, 6) AS mean_point, round(mean_window, 6) AS mean_window, round(p90, 6) AS p90, round(alignment_rmsd, 6) AS alignment_rmsd, round(inlier_fraction, 6) AS inlier_fraction
 FROM (SELECT structure, avg(residual) AS mean_point, avg(window_disagreement) AS mean_window, quantile_cont(window_disagreement, 0.9) AS p90, {SUMMARY} FROM dis GROUP BY 1)""",
)
def _(t):
    rows = structure.disagreement(aligned_sources(t), ["structure"])
    return rounded(structure.disagreement_summary(rows, ["structure"]), "mean_point", "mean_window", "p90", "alignment_rmsd", "inlier_fraction")


@query("st10_blend_conservative", heuristic_sql("conservative"))
def _(t):
    return rounded(structure.blend_heuristic(aligned_sources(t), ["structure"]).select("structure", "pos", "alpha", "x", "y", "z", "confidence"), "alpha", "x", "y", "z", "confidence")


@query("st10_blend_partner_heavy", heuristic_sql("heavy"))
def _(t):
    rows = structure.blend_heuristic(aligned_sources(t), ["structure"], mode="heavy")
    return rounded(rows.select("structure", "pos", "alpha", "x", "y", "z", "confidence"), "alpha", "x", "y", "z", "confidence")


@query("st11_blend_selective", selective_sql())
def _(t):
    rows = structure.disagreement(aligned_sources(t), ["structure"]).withColumn("probability", F.when((F.col("pos") + F.col("structure")) % 13 < 9, 0.9).otherwise(0.3))
    blended = structure.blend_selective(rows, ["structure"], "probability", 0.5, high=40.0)
    return rounded(blended.select("structure", "pos", "alpha", "x", "y", "z", "confidence"), "alpha", "x", "y", "z", "confidence")


@query("st12_blend_oracle", f"WITH {ALIGNED}, bl AS (SELECT *, CASE WHEN p_conf > t_conf THEN CAST(1 AS DOUBLE) ELSE 0 END AS alpha FROM al) " + BLEND.format("bl"))
def _(t):
    blended = structure.blend_oracle(aligned_sources(t), F.col("p_conf") > F.col("t_conf"))
    return rounded(blended.select("structure", "pos", "alpha", "x", "y", "z", "confidence"), "alpha", "x", "y", "z", "confidence")


@query("st13_gate_features")
def _(t):
    _, angle, torsion = _angle_priors(t)
    features = structure.gate_features(aligned_sources(t), ["structure"], "letter", 5.9, angle, torsion)
    return rounded(features, *[c for c in features.columns if c not in ("structure", "pos")])


@query("st14_make_examples", examples_sql())
def _(t):
    """Sources: each structure and its successor; natives: the two lowest ids of the target."""
    points = dense_points(t)
    natives = topk.topn(t.embeddings.select(F.col("label").cast("long").alias("target"), F.col("vec_id").alias("reference")), ["target"], [F.col("reference")], 2)
    native = points.join(natives, (points.structure == natives.reference) & (points.target == natives.target), "inner").select(
        natives.target, "reference", "pos", *[F.col(a).alias(f"q{a}") for a in "xyz"]
    )

    def against(source):
        pairs = source.withColumnsRenamed({a: f"p{a}" for a in "xyz"}).join(native, ["target", "pos"])
        return structure.robust_superpose(pairs, ["structure", "reference"])

    moved = points.withColumns({"x": F.col("x") * 1.1 + F.sin(F.col("pos") * 1.7 + F.col("structure")), "y": F.col("y") * 0.9})
    return rounded(structure.make_examples(against(points), against(moved), ["structure"], "reference"), "t_error", "p_error", "label", "weight")


def bank(t):
    return t.embeddings.select(F.col("label").cast("long").alias("target"), F.floor(F.col("vec_id") / 20).alias("bank"), F.col("vec_id").alias("id"), "embedding")


@query("st15_fold_families")
def _(t):
    return structure.fold_families(bank(t), ["target"], "id", "embedding", 0.15)


@query(
    "st16_selected_similarity",
    """WITH s AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS r FROM embeddings), c AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM s WHERE r <= 5)
 SELECT CAST(a.label AS BIGINT) AS target, CAST(5 AS BIGINT) AS selected, round(avg(list_cosine_similarity(a.e, b.e)), 6) AS mean_similarity FROM c a JOIN c b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1""",
)
def _(t):
    vectors = bank(t).drop("bank")
    selected = topk.topn(vectors.withColumn("q", F.get("embedding", F.lit(0))), ["target"], [F.desc("q"), F.col("id")], 5)
    return rounded(structure.selected_similarity(vectors, selected, ["target"], "id", "embedding"), "mean_similarity")


_SIGNALS = list(structure.QUALITY_WEIGHTS)


def _quality_sql() -> str:
    cols = []
    for k, name in enumerate(_SIGNALS):
        part = "target, source" if name == "source_confidence" else "target"
        rank = f"(rank() OVER (PARTITION BY {part} ORDER BY {name}) + (count(*) OVER (PARTITION BY {part}, {name}) - 1) / CAST(2 AS DOUBLE) - 1) / nullif(count(*) OVER (PARTITION BY {part}) - 1, 0)"
        flat = f"max({name}) OVER (PARTITION BY {part}) - min({name}) OVER (PARTITION BY {part}) <= 1e-12"
        value = f"CASE WHEN count(*) OVER (PARTITION BY {part}) <= 1 OR {flat} THEN 0.5 ELSE {rank} END"
        cols.append(value if name in ("source_confidence", "support_fraction", "pair_like_fraction") else f"1 - ({value})")
    total = " + ".join(f"{structure.QUALITY_WEIGHTS[n]} * ({c})" for n, c in zip(_SIGNALS, cols))
    signals = ", ".join(f"sum(l_quantity * ((l_partkey + {k}) % {7 + k})) AS {n}" for k, n in enumerate(_SIGNALS))
    return f"WITH f AS (SELECT l_suppkey AS target, l_linenumber AS id, l_returnflag AS source, {signals} FROM lineitem GROUP BY 1, 2, 3) SELECT target, id, source, round({total}, 6) AS quality FROM f"


@query("st17_quality_score", _quality_sql())
def _(t):
    signals = [F.sum(F.col("l_quantity") * ((F.col("l_partkey") + k) % (7 + k))).alias(n) for k, n in enumerate(_SIGNALS)]
    features = t.lineitem.groupBy(F.col("l_suppkey").alias("target"), F.col("l_linenumber").alias("id"), F.col("l_returnflag").alias("source")).agg(*signals)
    return structure.quality_score(features, ["target"], "source").select("target", "id", "source", F.round("quality", 6).alias("quality"))
