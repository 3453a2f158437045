"""Registered queries: operators along a chain or a rank."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from chainwright.operators import order, windows
from chainwright.plans.fixtures import CHAIN, DENSE, PAIRS, PANEL, PTS, SEQS, dense_points, event_chain, panel, reference_pairs, sequences, structure_points
from chainwright.plans.registry import query
from chainwright.plans.summaries import rounded
from chainwright.functions import sequence as S

_W = "WINDOW w AS (PARTITION BY structure ORDER BY pos)"
_LAG = f"lagged AS (SELECT *, lag(x) OVER w AS ax, lag(y) OVER w AS ay, lag(z) OVER w AS az, lead(x) OVER w AS cx, lead(y) OVER w AS cy, lead(z) OVER w AS cz, lead(x, 2) OVER w AS dx, lead(y, 2) OVER w AS dy, lead(z, 2) OVER w AS dz FROM pts {_W})"


@query(
    "wn01_adjacent_distance",
    f"WITH {PTS}, {_LAG} SELECT structure, pos, round(sqrt((x-ax)*(x-ax)+(y-ay)*(y-ay)+(z-az)*(z-az)), 6) AS distance FROM lagged WHERE x IS NOT NULL AND ax IS NOT NULL",
)
def _(t):
    return rounded(windows.adjacent_distance(structure_points(t), ["structure"], "pos"), "distance")


@query(
    "wn02_backbone_dev",
    f"WITH {PTS}, {_LAG} SELECT structure, round(avg(abs(sqrt((x-ax)*(x-ax)+(y-ay)*(y-ay)+(z-az)*(z-az)) - 5.9)), 6) AS bb_dev FROM lagged WHERE x IS NOT NULL AND ax IS NOT NULL GROUP BY 1",
)
def _(t):
    return rounded(windows.backbone_dev(structure_points(t), ["structure"], "pos", 5.9), "bb_dev")


ANGLES = (
    _LAG
    + """, ang AS (SELECT structure, pos, acos(least(greatest(((ax-x)*(cx-x)+(ay-y)*(cy-y)+(az-z)*(cz-z)) / (sqrt((ax-x)*(ax-x)+(ay-y)*(ay-y)+(az-z)*(az-z)) * sqrt((cx-x)*(cx-x)+(cy-y)*(cy-y)+(cz-z)*(cz-z))), -1), 1)) AS angle,
  ax IS NOT NULL AND x IS NOT NULL AND cx IS NOT NULL AS angle_valid, ax IS NOT NULL AND x IS NOT NULL AND cx IS NOT NULL AND dx IS NOT NULL AS torsion_valid,
  x-ax AS b0x, y-ay AS b0y, z-az AS b0z, sqrt((cx-x)*(cx-x)+(cy-y)*(cy-y)+(cz-z)*(cz-z)) AS l, (cx-x)/l AS ux, (cy-y)/l AS uy, (cz-z)/l AS uz, dx-cx AS b2x, dy-cy AS b2y, dz-cz AS b2z,
  b0x*ux+b0y*uy+b0z*uz AS d0, b2x*ux+b2y*uy+b2z*uz AS d2, b0x-d0*ux AS vx, b0y-d0*uy AS vy, b0z-d0*uz AS vz, b2x-d2*ux AS wx, b2y-d2*uy AS wy, b2z-d2*uz AS wz,
  atan2((uy*vz-uz*vy)*wx+(uz*vx-ux*vz)*wy+(ux*vy-uy*vx)*wz, vx*wx+vy*wy+vz*wz) AS torsion FROM lagged)"""
)


@query("wn03_pseudo_angle", f"WITH {PTS}, {ANGLES} SELECT structure, pos, round(angle, 6) AS angle FROM ang WHERE angle_valid")
def _(t):
    return windows.local_angles(structure_points(t), ["structure"], "pos").where("angle_valid").select("structure", "pos", F.round("angle", 6).alias("angle"))


@query("wn03_kink_fraction", f"WITH {PTS}, {ANGLES} SELECT structure, round(avg(CASE WHEN degrees(angle) < 70 THEN 1.0 ELSE 0.0 END), 6) AS sharp_kinks FROM ang WHERE angle_valid GROUP BY 1")
def _(t):
    return rounded(windows.kink_fraction(structure_points(t), ["structure"], "pos"), "sharp_kinks")


@query("wn04_pseudo_torsion", f"WITH {PTS}, {ANGLES} SELECT structure, pos, round(torsion, 6) AS torsion FROM ang WHERE torsion_valid")
def _(t):
    return windows.local_angles(structure_points(t), ["structure"], "pos").where("torsion_valid").select("structure", "pos", F.round("torsion", 6).alias("torsion"))


@query(
    "wn05_local_validity",
    f"""WITH {CHAIN}, k AS (SELECT * FROM chain WHERE event_id % 29 <> 0) SELECT a.chain, a.pos, (coalesce(a.ok AND b.ok AND c.ok, FALSE)) AS angle_valid, (coalesce(a.ok AND b.ok AND c.ok AND d.ok, FALSE)) AS torsion_valid
 FROM k a LEFT JOIN k b ON b.chain = a.chain AND b.pos = a.pos - 1 LEFT JOIN k c ON c.chain = a.chain AND c.pos = a.pos + 1 LEFT JOIN k d ON d.chain = a.chain AND d.pos = a.pos + 2""",
)
def _(t):
    broken = event_chain(t).where(F.col("event_id") % 29 != 0)
    return windows.local_angles(broken, ["chain"], "pos").select("chain", "pos", "angle_valid", "torsion_valid")


def rmsd_sql(source: str, keys: str, name: str = "rmsd") -> str:
    """SELECT that turns the superposition sums of ``source`` into the deviation."""
    steps = [f"h{a}{b} - p{a}*q{b}/n AS c{a}{b}" for a in "xyz" for b in "xyz"]
    steps += [f"cx{a}*cx{b} + cy{a}*cy{b} + cz{a}*cz{b} AS g{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]
    steps += [
        "cxx*(cyy*czz-cyz*czy) - cxy*(cyx*czz-cyz*czx) + cxz*(cyx*czy-cyy*czx) AS det",
        "(gxx+gyy+gzz)/3 AS tr",
        "sqrt(((gxx-tr)*(gxx-tr)+(gyy-tr)*(gyy-tr)+(gzz-tr)*(gzz-tr)+2*(gxy*gxy+gxz*gxz+gyz*gyz))/6) AS wd",
        "CASE WHEN wd > 0 THEN ((gxx-tr)*((gyy-tr)*(gzz-tr)-gyz*gyz) - gxy*(gxy*(gzz-tr)-gyz*gxz) + gxz*(gxy*gyz-(gyy-tr)*gxz))/(wd*wd*wd)/2 ELSE 0 END AS rr",
        "acos(least(greatest(rr, -1), 1))/3 AS ph",
        "tr + 2*wd*cos(ph) AS e1",
        "tr + 2*wd*cos(ph + 2*pi()/3) AS e3",
        "sqrt(greatest(e1, 0)) AS s1",
        "sqrt(greatest(3*tr - e1 - e3, 0)) AS s2",
        "CASE WHEN s1*s2 > 0 THEN det/(s1*s2) ELSE 0 END AS s3",
        "pp - (px*px+py*py+pz*pz)/n + qq - (qx*qx+qy*qy+qz*qz)/n AS gg",
        "CASE WHEN gg - 2*(s1+s2+s3) < 1e-9 * gg THEN 0 ELSE (gg - 2*(s1+s2+s3))/n END AS ms",
        f"CASE WHEN n >= 3 THEN sqrt(greatest(ms, 0)) END AS {name}",
    ]
    return f"SELECT {keys}, n, {', '.join(steps)} FROM {source}"


def sums_sql(over: str = "") -> str:
    parts = [f"count(CASE WHEN s THEN 1 END) {over} AS n"]
    for a in "xyz":
        parts += [f"sum(CASE WHEN s THEN p{a}_ END) {over} AS p{a}", f"sum(CASE WHEN s THEN q{a}_ END) {over} AS q{a}"]
        parts += [f"sum(CASE WHEN s THEN p{a}_*q{b}_ END) {over} AS h{a}{b}" for b in "xyz"]
    for c in "pq":
        parts.append(f"sum(CASE WHEN s THEN {c}x_*{c}x_+{c}y_*{c}y_+{c}z_*{c}z_ END) {over} AS {c}{c}")
    return ", ".join(parts)


CENTRED = "cen AS (SELECT target, structure, pos, s, last, " + ", ".join(f"{c}{a} - avg(CASE WHEN s THEN {c}{a} END) OVER (PARTITION BY structure) AS {c}{a}_" for c in "pq" for a in "xyz") + " FROM (SELECT *, px IS NOT NULL AND qx IS NOT NULL AS s, max(pos) OVER (PARTITION BY structure) AS last FROM pairs))"


def sliding_sql(window: int) -> str:
    over = f"OVER (PARTITION BY structure ORDER BY pos ROWS BETWEEN CURRENT ROW AND {window - 1} FOLLOWING)"
    return (
        f"wsum AS (SELECT structure, pos, s, last, {sums_sql(over)} FROM cen), wr AS (SELECT structure, pos, s, CASE WHEN pos <= greatest(last - {window - 1}, 0) THEN wv END AS window_rmsd FROM ("
        + rmsd_sql("wsum", "structure, pos, s, last", "wv")
        + f")), wp AS (SELECT *, CASE WHEN s THEN avg(window_rmsd) OVER (PARTITION BY structure ORDER BY pos ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW) END AS per_residue FROM wr)"
    )


@query("wn06_sliding_rmsd", f"WITH {PAIRS}, {CENTRED}, {sliding_sql(9)} SELECT structure, pos, round(window_rmsd, 5) AS window_rmsd, round(per_residue, 5) AS per_residue FROM wp")
def _(t):
    rows = windows.sliding_rmsd(reference_pairs(t), ["structure"], "pos", 9)
    return rounded(rows.select("structure", "pos", "window_rmsd", "per_residue"), "window_rmsd", "per_residue", digits=5)


NEAR = """near AS (SELECT *, max(CASE WHEN ok THEN pos END) OVER (PARTITION BY chain ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a,
 min(CASE WHEN ok THEN pos END) OVER (PARTITION BY chain ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM chain)"""


@query(
    "wn07_gap_runs",
    f"""WITH {CHAIN}, g AS (SELECT chain, length, pos, pos - row_number() OVER (PARTITION BY chain ORDER BY pos) AS isl FROM chain WHERE NOT ok)
 SELECT chain, min(pos) AS start, CAST(count(*) AS BIGINT) AS size, min(pos) = 0 OR max(pos) = max(length) - 1 AS terminal,
 CASE WHEN count(*) <= 3 THEN '1-3' WHEN count(*) <= 8 THEN '4-8' WHEN count(*) <= 20 THEN '9-20' ELSE '>20' END AS bin FROM g GROUP BY chain, isl""",
)
def _(t):
    runs = windows.gap_runs(event_chain(t), ["chain"], "pos", F.col("ok"), "length")
    return runs.withColumn("bin", S.bins(F.col("size"), [3, 8, 20], ["1-3", "4-8", "9-20", ">20"]))


@query(
    "wn08_run_mask",
    f"""WITH {CHAIN}, i AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY chain ORDER BY pos) AS isl FROM chain)
 SELECT chain, pos, ok AND count(CASE WHEN ok THEN 1 END) OVER (PARTITION BY chain, isl) >= 7 AS kept FROM i""",
)
def _(t):
    return windows.run_mask(event_chain(t).select("chain", "pos", "ok", "length"), ["chain"], "pos", "ok", "length").select("chain", "pos", "kept")


_ENDS = (
    NEAR
    + """, ends AS (SELECT chain, min(CASE WHEN ok THEN pos END) AS f, max(CASE WHEN ok THEN pos END) AS l, min(CASE WHEN ok AND a IS NULL THEN b END) AS f2, max(CASE WHEN ok AND b IS NULL THEN a END) AS l2 FROM near GROUP BY 1),
 full_rows AS (SELECT n.chain, n.pos, n.ok, n.x, n.y, n.z, n.a, n.b, f, l, f2, l2, ca.x AS ax, ca.y AS ay, ca.z AS az, cb.x AS bx, cb.y AS "by", cb.z AS bz, cf.x AS fx, cf.y AS fy, cf.z AS fz, cg.x AS gx, cg.y AS gy, cg.z AS gz, cl.x AS lx, cl.y AS ly, cl.z AS lz, cm.x AS mx, cm.y AS my, cm.z AS mz
  FROM near n JOIN ends e ON e.chain = n.chain LEFT JOIN chain ca ON ca.chain = n.chain AND ca.pos = n.a LEFT JOIN chain cb ON cb.chain = n.chain AND cb.pos = n.b
  LEFT JOIN chain cf ON cf.chain = n.chain AND cf.pos = f LEFT JOIN chain cg ON cg.chain = n.chain AND cg.pos = f2 LEFT JOIN chain cl ON cl.chain = n.chain AND cl.pos = l LEFT JOIN chain cm ON cm.chain = n.chain AND cm.pos = l2)"""
)
_FILL_CASES = """CASE WHEN ok THEN 1.0 WHEN a IS NOT NULL AND b IS NOT NULL THEN 0.3*(1-abs(2*t-1)) ELSE 0.1 END AS confidence"""


def _fill_sql(curved: bool) -> str:
    bump = "CASE WHEN b-a-1 >= 3 AND sl > 1e-6 THEN 3.0*least(1.0, (b-a-1)/CAST(6 AS DOUBLE))*sin(pi()*t) ELSE 0 END" if curved else "0"
    axes = []
    for c, bc in (("x", "bx"), ("y", '"by"'), ("z", "bz")):
        inner = f"a{c} + t*({bc}-a{c}) + u{c}*bump" if curved else f"(1-t)*a{c} + t*{bc}"
        axes.append(
            f"round(CASE WHEN ok THEN {c} WHEN a IS NOT NULL AND b IS NOT NULL THEN {inner} WHEN a IS NULL THEN f{c} + (f{c}-g{c})/(fl+1e-8)*6*(f-pos) ELSE l{c} + (l{c}-m{c})/(ll+1e-8)*6*(pos-l) END, 6) AS {c}"
        )
    extra = (
        ", (bx-ax)/(sl+1e-8) AS dx, (\"by\"-ay)/(sl+1e-8) AS dy, (bz-az)/(sl+1e-8) AS dz, CASE WHEN abs(dx) < 0.9 THEN 1 ELSE 0 END AS rx, 1-rx AS ry, rx*dx+ry*dy AS rd, rx-dx*rd AS vx, ry-dy*rd AS vy, -dz*rd AS vz, sqrt(vx*vx+vy*vy+vz*vz)+1e-8 AS vn, vx/vn AS ux, vy/vn AS uy, vz/vn AS uz"
        if curved
        else ""
    )
    return f"""WITH {CHAIN}, {_ENDS}, s AS (SELECT *, (pos-a)/CAST(b-a AS DOUBLE) AS t, sqrt((bx-ax)*(bx-ax)+("by"-ay)*("by"-ay)+(bz-az)*(bz-az)) AS sl, sqrt((fx-gx)*(fx-gx)+(fy-gy)*(fy-gy)+(fz-gz)*(fz-gz)) AS fl, sqrt((lx-mx)*(lx-mx)+(ly-my)*(ly-my)+(lz-mz)*(lz-mz)) AS ll FROM full_rows),
 s2 AS (SELECT *, {bump} AS bump {extra} FROM s) SELECT chain, pos, {", ".join(axes)}, round({_FILL_CASES.replace(" AS confidence", "")}, 6) AS confidence FROM s2"""


@query("wn09_fill_gaps_linear", _fill_sql(False))
def _(t):
    return rounded(windows.fill_gaps(event_chain(t), ["chain"], "pos"), "x", "y", "z", "confidence")


@query("wn10_fill_gaps_curved", _fill_sql(True))
def _(t):
    return rounded(windows.fill_gaps(event_chain(t), ["chain"], "pos", curved=True), "x", "y", "z", "confidence")


def _inner_sql(p: str, q: str, span: str, t: str) -> list[str]:
    """Lateral columns computing the span-aware point between p and q as i<axis>_<p>."""
    k = p
    seg = [f"({q}{c}-{p}{c})" if not q == "b" or c != "y" else f'("by"-{p}y)' for c in "xyz"]
    return [
        f"sqrt({'+'.join(f'{g}*{g}' for g in seg)}) AS n_{k}",
        *[f"{g}/(n_{k}+1e-10) AS d{c}_{k}" for g, c in zip(seg, "xyz")],
        f"sqrt(dy_{k}*dy_{k}+dx_{k}*dx_{k}) < 1e-6 AS flat_{k}",
        f"CASE WHEN flat_{k} THEN 0 ELSE dy_{k} END AS sx_{k}",
        f"CASE WHEN flat_{k} THEN dz_{k} ELSE -dx_{k} END AS sy_{k}",
        f"CASE WHEN flat_{k} THEN -dy_{k} ELSE 0 END AS sz_{k}",
        f"sqrt(sx_{k}*sx_{k}+sy_{k}*sy_{k}+sz_{k}*sz_{k})+1e-10 AS sn_{k}",
        *[
            f"CASE WHEN n_{k} < {span}*5.9*0.7 THEN {p}{c} + d{c}_{k}*{span}*5.9*{t} + s{c}_{k}/sn_{k}*2*sin({t}*pi()) ELSE (1-{t})*{p}{c} + {t}*({p}{c}+{g}) END AS i{c}_{k}"
            for g, c in zip(seg, "xyz")
        ],
    ]


_SPAN = f"""WITH {CHAIN}, {_ENDS}, s AS (SELECT *, (pos-a)/CAST(b-a AS DOUBLE) AS t, (l-l2-1)/CAST(l-l2 AS DOUBLE) AS te, {", ".join(_inner_sql("a", "b", "(b-a)", "t"))}, {", ".join(_inner_sql("m", "l", "(l-l2)", "te"))} FROM full_rows),
 e AS (SELECT *, {", ".join(f"l{c} - CASE WHEN l-l2 = 1 THEN m{c} ELSE i{c}_m END AS o{c}" for c in "xyz")}, sqrt(ox*ox+oy*oy+oz*oz)+1e-10 AS ol FROM s)
 SELECT chain, pos, {", ".join(f"round(CASE WHEN ok THEN {c} WHEN a IS NOT NULL AND b IS NOT NULL THEN i{c}_a WHEN a IS NULL THEN f{c} + {'5.9*(f-pos)' if c == 'x' else '0'} ELSE l{c} + o{c}/ol*5.9*(pos-l) END, 6) AS {c}" for c in "xyz")}, round({_FILL_CASES.replace(" AS confidence", "")}, 6) AS confidence FROM e"""


@query("wn11_fill_gaps_span", _SPAN)
def _(t):
    return rounded(windows.fill_gaps_span(event_chain(t), ["chain"], "pos"), "x", "y", "z", "confidence")


@query(
    "wn12_rank01",
    f"""WITH {PANEL}, r AS (SELECT target, setting, candidate, rank() OVER (PARTITION BY target ORDER BY size) + (count(*) OVER (PARTITION BY target, size) - 1) / CAST(2 AS DOUBLE) AS k, count(*) OVER (PARTITION BY target) AS n, max(size) OVER (PARTITION BY target) - min(size) OVER (PARTITION BY target) AS spread FROM panel),
 v AS (SELECT *, CASE WHEN n <= 1 OR spread <= 1e-12 THEN 0.5 ELSE (k-1)/(n-1) END AS s FROM r) SELECT target, setting, candidate, round(s, 6) AS rank01, round(1-s, 6) AS rank01_low, round(0.25+0.75*s, 6) AS relative_confidence FROM v""",
)
def _(t):
    ranked = windows.rank01(panel(t), ["target"], "size")
    both = ranked.withColumn("rank01_low", 1 - F.col("rank01")).withColumn("relative_confidence", 0.25 + 0.75 * F.col("rank01"))
    return rounded(both.select("target", "setting", "candidate", "rank01", "rank01_low", "relative_confidence"), "rank01", "rank01_low", "relative_confidence")


def _smooth_sql(weights: dict[int, float], column: str = "value") -> str:
    term = lambda o: f"coalesce({'lag' if o < 0 else 'lead'}({column}, {abs(o)}) OVER w, {'first' if o < 0 else 'last'}_value({column}) OVER (PARTITION BY chain ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
    return " + ".join(f"{w!r} * {term(o) if o else column}" for o, w in weights.items())


@query(
    "wn13_smooth",
    f"""WITH {CHAIN} SELECT chain, pos, round({_smooth_sql(windows.gaussian_weights(2, 2 / 1.5))}, 6) AS gaussian, round({_smooth_sql({o: 1 / 15 for o in range(-7, 8)})}, 6) AS uniform FROM chain WINDOW w AS (PARTITION BY chain ORDER BY pos)""",
)
def _(t):
    rows = event_chain(t).select("chain", "pos", "length", "value")
    once = windows.smooth(rows, ["chain"], "pos", "value", windows.gaussian_weights(2, 2 / 1.5), "gaussian")
    both = windows.smooth(once, ["chain"], "pos", "value", windows.uniform_weights(15, F.col("length")), "uniform")
    return rounded(both.select("chain", "pos", "gaussian", "uniform"), "gaussian", "uniform")


@query("wn14_center", f"WITH {PANEL} SELECT target, setting, candidate, round(score - avg(score) OVER (PARTITION BY target), 6) AS centred FROM panel")
def _(t):
    return rounded(windows.center(panel(t), ["target"], "score", "centred").select("target", "setting", "candidate", "centred"), "centred")


@query(
    "wn15_distance_to_false",
    f"""WITH {CHAIN}, n AS (SELECT *, max(CASE WHEN NOT ok THEN pos END) OVER (PARTITION BY chain ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a, min(CASE WHEN NOT ok THEN pos END) OVER (PARTITION BY chain ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM chain)
 SELECT chain, pos, round(CASE WHEN NOT ok THEN 0 ELSE least(coalesce(least(pos-a, b-pos), 20)/CAST(20 AS DOUBLE), 1) END, 6) AS support_distance FROM n""",
)
def _(t):
    rows = windows.distance_to_false(event_chain(t).select("chain", "pos", "ok"), ["chain"], "pos", "ok")
    return rounded(rows.select("chain", "pos", "support_distance"), "support_distance")


@query(
    "wn16_scatter_average",
    f"""WITH {DENSE}, d AS (SELECT structure, pos, abs(sqrt((nx-x)*(nx-x)+(ny-y)*(ny-y)+(nz-z)*(nz-z)) - 5.9) AS v FROM (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(z) OVER w AS nz FROM dense {_W}))
 SELECT structure, pos, round(coalesce((coalesce(v, 0) + coalesce(lv, 0)) / nullif((v IS NOT NULL)::INT + (lv IS NOT NULL)::INT, 0), 0), 6) AS bb_local FROM (SELECT *, lag(v) OVER w AS lv FROM d {_W})""",
)
def _(t):
    steps = windows.adjacent_distance(dense_points(t), ["structure"], "pos").select("structure", (F.col("pos") - 1).alias("pos"), F.abs(F.col("distance") - 5.9).alias("v"))
    rows = dense_points(t).select("structure", "pos").join(steps, ["structure", "pos"], "left")
    return rounded(windows.scatter_average(rows, ["structure"], "pos", "v", "bb_local").select("structure", "pos", "bb_local"), "bb_local")


@query(
    "wn17_grouped_temporal_split",
    """WITH o AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS date, o_custkey AS grp FROM orders), d AS (SELECT date, sum(n) OVER (ORDER BY date) AS run, sum(n) OVER () AS total FROM (SELECT date, count(*) AS n FROM o GROUP BY 1)),
 b AS (SELECT o.*, CASE WHEN run <= total * (1 - CAST(0.15 AS DOUBLE) - CAST(0.2 AS DOUBLE)) THEN 0 WHEN run <= total * (1 - CAST(0.2 AS DOUBLE)) THEN 1 ELSE 2 END AS band FROM o JOIN d USING (date))
 SELECT id, date, grp, ['train', 'calibration', 'validation'][band + 1] AS split FROM (SELECT *, max(band) OVER (PARTITION BY grp) AS top FROM b) WHERE band = top""",
)
def _(t):
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("date"), F.col("o_custkey").alias("grp"))
    return windows.grouped_temporal_split(rows, "date", "grp").select("id", "date", "grp", "split")


@query(
    "wn18_temporal_split",
    """WITH o AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS date FROM orders), r AS (SELECT *, row_number() OVER (ORDER BY date, id) - 1 AS i, count(*) OVER () AS n FROM o),
 e AS (SELECT max(n) AS n, max(least(greatest(round_even(n * (1 - CAST(0.15 AS DOUBLE) - CAST(0.2 AS DOUBLE)), 0), 1), n - 2)) AS te FROM r), e2 AS (SELECT *, least(greatest(round_even(n * (1 - CAST(0.2 AS DOUBLE)), 0), te + 1), n - 1) AS ce FROM e),
 t AS (SELECT (SELECT date FROM r WHERE i = te) AS td, (SELECT date FROM r WHERE i = ce) AS cd FROM e2) SELECT id, date, CASE WHEN date < td THEN 'train' WHEN date < cd THEN 'calibration' ELSE 'validation' END AS split FROM o, t""",
)
def _(t):
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("date"))
    return windows.temporal_split(rows, "date", 0.15, 0.20).select("id", "date", "split")


@query(
    "wn19_spaced_sample",
    """WITH r AS (SELECT o_orderpriority AS split, o_orderkey AS id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY CAST(o_orderdate AS DATE), o_orderkey) - 1 AS pos, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
 w AS (SELECT DISTINCT split, CAST(round_even(i * ((n - 1) / CAST(39 AS DOUBLE)), 0) AS BIGINT) AS pos FROM (SELECT DISTINCT split, n FROM r), range(40) AS g(i)) SELECT r.split, r.id, CAST(r.pos AS BIGINT) AS pos FROM r JOIN w ON r.split = w.split AND r.pos = w.pos""",
)
def _(t):
    rows = t.orders.select(F.col("o_orderpriority").alias("split"), F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("date"))
    return windows.spaced_sample(rows, ["split"], ["date", "id"], F.col("date"), 40).select("split", "id", "pos")


@query(
    "wn20_representatives",
    f"""WITH {SEQS}, g AS (SELECT doc_id, sha256(seq) AS digest, CAST(DATE '2020-01-01' + CAST(n_chars % 365 AS INTEGER) AS DATE) AS date FROM seqs)
 SELECT doc_id, first_value(doc_id) OVER (PARTITION BY digest ORDER BY date DESC, doc_id) AS representative, CAST(count(*) OVER (PARTITION BY digest) AS BIGINT) AS members FROM g""",
)
def _(t):
    rows = sequences(t).select("doc_id", S.seq_digest(F.col("seq")).alias("digest"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("n_chars") % 365).cast("int")).alias("date"))
    return windows.representatives(rows, "digest", "date", "doc_id").select("doc_id", "representative", "members")


@query(
    "wn21_tertiles",
    """WITH p AS (SELECT p_partkey AS id, p_retailprice AS v, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS r, count(*) OVER () AS n FROM part)
 SELECT id, CAST(least(2, floor(3 * (r - 1) / CAST(n - 1 AS DOUBLE))) AS INTEGER) AS tertile, CASE WHEN v < 1000 THEN 'low' WHEN v < 1400 THEN 'mid' ELSE 'high' END AS cut FROM p""",
)
def _(t):
    rows = t.part.select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("v"))
    table = windows.tertiles(rows, "v", "id")
    return table.select("id", "tertile", S.bins(F.col("v"), [1000, 1400], ["low", "mid", "high"], right_closed=False).alias("cut"))
