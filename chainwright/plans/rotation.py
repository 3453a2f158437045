"""SQL of superposition, repeated trimming and blending, for the queries on pairs of sources."""

from __future__ import annotations

from chainwright.functions import vectors as V
from chainwright.operators import windows
from chainwright.plans.fixtures import DENSE


class _Text(str):
    """A name or number in a formula, so that formulas written for columns give SQL too."""

    def __add__(self, other):
        return _Text(f"({self} + {other})")

    def __sub__(self, other):
        return _Text(f"({self} - {other})")

    def __mul__(self, other):
        return _Text(f"({self} * {other})")

    def __neg__(self):
        return _Text(f"(-{self})")


_NAMES = "wxyz"
_PAIRS = [a + b for i, a in enumerate(_NAMES) for b in _NAMES[i:]]
_entry = lambda a, b: a + b if _NAMES.index(a) <= _NAMES.index(b) else b + a


def rotation_sql(source: str, keys: str) -> str:
    """SELECT that turns sums of pairs (n, p*, q*, h**) into the rotation r0..r8 and the shift t0..t2 of p onto q."""
    steps = [f"h{a}{b} - p{a}*q{b}/n AS c{a}{b}" for a in "xyz" for b in "xyz"]
    steps += [
        "cxx+cyy+czz AS nww", "cyz-czy AS nwx", "czx-cxz AS nwy", "cxy-cyx AS nwz", "cxx-cyy-czz AS nxx", "cxy+cyx AS nxy", "czx+cxz AS nxz",
        "cyy-cxx-czz AS nyy", "cyz+czy AS nyz", "czz-cxx-cyy AS nzz",
        "+".join(f"c{a}{b}*c{a}{b}" for a in "xyz" for b in "xyz") + " AS sz",
        "cxx*(cyy*czz-cyz*czy) - cxy*(cyx*czz-cyz*czx) + cxz*(cyx*czy-cyy*czx) AS det",
        " + ".join(f"n{_entry('w', x)}*{V.cofactor(lambda k: _Text('n' + k), 'w', x)}" for x in _NAMES) + " AS lst",
        "list_reduce(list_prepend(sqrt(3*sz), CAST(range(60) AS DOUBLE[])), lambda l, i: CASE WHEN l*(4*l*l-4*sz)-8*det > 0 THEN l - (l*(l*(l*l-2*sz)-8*det)+lst)/(l*(4*l*l-4*sz)-8*det) ELSE l END) AS lam",
    ]
    steps += [f"n{k}{' - lam' if k[0] == k[1] else ''} AS b{k}" for k in _PAIRS]
    steps += [f"{V.cofactor(lambda e: _Text('b' + e), *k)} AS a{k}" for k in _PAIRS]
    steps.append("greatest(" + ", ".join(f"abs(a{x}{x})" for x in _NAMES) + ") AS far")
    for k in _NAMES:
        cases = " ".join(f"WHEN abs(a{x}{x}) = far THEN a{_entry(x, k)}" for x in _NAMES[:-1])
        steps.append(f"CASE {cases} ELSE a{_entry('z', k)} END AS v{k}")
    steps.append("sqrt(vw*vw+vx*vx+vy*vy+vz*vz) AS vl")
    steps += [f"v{k}/vl AS u{k}" for k in _NAMES]
    turn = [
        "uw*uw+ux*ux-uy*uy-uz*uz", "2*(ux*uy-uw*uz)", "2*(ux*uz+uw*uy)", "2*(ux*uy+uw*uz)", "uw*uw-ux*ux+uy*uy-uz*uz", "2*(uy*uz-uw*ux)",
        "2*(ux*uz-uw*uy)", "2*(uy*uz+uw*ux)", "uw*uw-ux*ux-uy*uy+uz*uz",
    ]
    steps += [f"{e} AS r{i}" for i, e in enumerate(turn)]
    steps += [f"(q{a} - r{3 * i}*px - r{3 * i + 1}*py - r{3 * i + 2}*pz)/n AS t{i}" for i, a in enumerate("xyz")]
    return f"SELECT {keys}, n, {', '.join(steps)} FROM {source} WHERE n >= 3"


def pair_sums(active: str) -> str:
    parts = [f"count(CASE WHEN {active} THEN 1 END) AS n"]
    for a in "xyz":
        parts += [f"sum(CASE WHEN {active} THEN p{a} END) AS p{a}", f"sum(CASE WHEN {active} THEN q{a} END) AS q{a}"]
        parts += [f"sum(CASE WHEN {active} THEN p{a}*q{b} END) AS h{a}{b}" for b in "xyz"]
    return ", ".join(parts)


MOVED = ", ".join(f"r{3 * i}*px + r{3 * i + 1}*py + r{3 * i + 2}*pz + t{i} AS a{a}" for i, a in enumerate("xyz"))
_GAP = "sqrt((ax-qx)*(ax-qx)+(ay-qy)*(ay-qy)+(az-qz)*(az-qz))"


def robust_sql(source: str, keys: str, name: str, trim: float = 0.8, rounds: int = 3) -> str:
    """Common table expressions that superpose the rows of ``source`` (with a boolean ``anchor``) and trim; the last is ``name``."""
    own = f"PARTITION BY {keys}"
    using = f"USING ({keys})"
    parts = [f"{name}0 AS (SELECT *, base AS inlier FROM (SELECT *, CASE WHEN count(CASE WHEN anchor THEN 1 END) OVER ({own}) >= 3 THEN anchor ELSE true END AS base FROM {source}))"]
    for k in range(rounds):
        parts += [
            f"{name}s{k} AS (SELECT {keys}, {pair_sums('inlier')} FROM {name}{k} GROUP BY ALL)",
            f"{name}r{k} AS MATERIALIZED ({rotation_sql(f'{name}s{k}', keys)})",
            f"{name}f{k} AS (SELECT s.*, {MOVED}, {_GAP} AS residual FROM {name}{k} s LEFT JOIN (SELECT {keys}, {', '.join(f'r{i}' for i in range(9))}, t0, t1, t2 FROM {name}r{k}) {using})",
            f"{name}c{k} AS (SELECT {keys}, quantile_cont(residual, {trim}) AS cut, count(*) AS kept FROM {name}f{k} WHERE inlier GROUP BY ALL)",
            f"{name}n{k} AS (SELECT f.*, kept, base AND residual <= cut AS nxt FROM {name}f{k} f JOIN {name}c{k} {using})",
            f"{name}{k + 1} AS MATERIALIZED (SELECT * EXCLUDE (inlier, nxt, kept, nn{', ax, ay, az, residual' if k < rounds - 1 else ''}), CASE WHEN kept > 3 AND nn >= 3 THEN nxt ELSE inlier END AS inlier FROM (SELECT *, count(CASE WHEN nxt THEN 1 END) OVER ({own}) AS nn FROM {name}n{k}))",
        ]
    return ", ".join(parts) + f", {name} AS (SELECT * FROM {name}{rounds})"


SOURCES = (
    DENSE
    + """, fst AS (SELECT target, min(structure) AS reference FROM dense GROUP BY 1),
 src AS (SELECT p.target, p.structure, p.pos, CAST(21 AS BIGINT) AS length, p.x AS px, p.y AS py, p.z AS pz, q.x AS qx, q.y AS qy, q.z AS qz,
  (p.structure*7 + p.pos*3) % 10 / CAST(10 AS DOUBLE) + 0.05 AS t_conf, (p.structure*3 + p.pos*7) % 9 / CAST(10 AS DOUBLE) + 0.1 AS p_conf, (p.structure + p.pos) % 5 <> 0 AS t_support, t_support AND t_conf >= 0.25 AS anchor
  FROM dense p JOIN fst ON fst.target = p.target JOIN dense q ON q.structure = fst.reference AND q.pos = p.pos)"""
)
ALIGNED = f"{SOURCES}, {robust_sql('src', 'structure', 'al')}"
SUMMARY = "sqrt(avg(CASE WHEN inlier THEN residual*residual END)) AS alignment_rmsd, avg(CASE WHEN inlier THEN 1.0 ELSE 0.0 END) AS inlier_fraction"


def smooth_sql(source: str, value: str, weights: dict[int, float], name: str, out: str) -> str:
    """Weighted sum over neighbours along a chain of 21, ends repeated."""
    total = " + ".join(f"{w!r} * vs[greatest(1, least(21, pos + {o + 1}))]" for o, w in weights.items())
    return f"{out} AS (SELECT s.*, {total} AS {name} FROM {source} s JOIN (SELECT structure, list({value} ORDER BY pos) AS vs FROM {source} GROUP BY 1) USING (structure))"


DISAGREEMENT = f"{ALIGNED}, {smooth_sql('al', 'residual', {o: 1 / 15 for o in range(-7, 8)}, 'window_disagreement', 'dis')}"
BLEND = "SELECT structure, pos, round(alpha, 6) AS alpha, " + ", ".join(f"round((1-alpha)*q{a} + alpha*a{a}, 6) AS {a}" for a in "xyz") + ", round(least(greatest((1-alpha)*t_conf + alpha*p_conf, 0.01), 1), 6) AS confidence FROM {}"


def heuristic_sql(mode: str) -> str:
    def capped(alpha: str) -> str:
        if mode == "conservative":
            return f"CASE WHEN residual > 12 AND t_support THEN 0 WHEN residual > 12 THEN 1 WHEN t_support AND t_conf >= 0.5 THEN least({alpha}, 0.15) END"
        return f"CASE WHEN residual > 12 OR NOT t_support THEN 1 ELSE greatest({alpha}, 0.7) END"

    rank = """CASE WHEN max(p_conf) OVER o - min(p_conf) OVER o <= 1e-8 THEN 0.5 ELSE (rank() OVER (PARTITION BY structure ORDER BY p_conf) + (count(*) OVER (PARTITION BY structure, p_conf) - 1) / CAST(2 AS DOUBLE) - 1) / 20 END"""
    first = capped("raw") if mode != "conservative" else f"coalesce({capped('raw')}, CASE WHEN NOT t_support THEN 0.9 ELSE raw END)"
    again = capped("sm") if mode != "conservative" else f"coalesce({capped('sm')}, sm)"
    return (
        f"WITH {ALIGNED}, rk AS (SELECT *, 0.25 + 0.75 * ({rank}) AS pq, pq / (least(greatest(t_conf, 0.01), 1) + pq) AS raw FROM al WINDOW o AS (PARTITION BY structure)), fa AS (SELECT *, CAST({first} AS DOUBLE) AS first FROM rk), "
        + smooth_sql("fa", "first", windows.gaussian_weights(2, 2 / 1.5), "sm", "so")
        + f", bl AS (SELECT *, least(greatest(CAST({again} AS DOUBLE), 0), 1) AS alpha FROM so) "
        + BLEND.format("bl")
    )


def selective_sql() -> str:
    return (
        f"WITH {DISAGREEMENT}, sw AS (SELECT *, CASE WHEN (pos + structure) % 13 < 9 THEN 0.9 ELSE 0.3 END >= 0.65 AND window_disagreement BETWEEN 0.5 AND 40 AS on_ FROM dis),"
        " isl AS (SELECT *, sum(CASE WHEN on_ THEN 0 ELSE 1 END) OVER (PARTITION BY structure ORDER BY pos) AS i FROM sw), kp AS (SELECT *, on_ AND count(CASE WHEN on_ THEN 1 END) OVER (PARTITION BY structure, i) >= 7 AS kept FROM isl),"
        " ka AS (SELECT *, CASE WHEN kept THEN CAST(1 AS DOUBLE) ELSE 0 END AS ka FROM kp WHERE structure IN (SELECT structure FROM kp WHERE kept)), "
        + smooth_sql("ka", "ka", windows.gaussian_weights(4, 1.0), "sm", "so")
        + ", bl AS (SELECT *, least(greatest(sm, 0), 1) AS alpha FROM so) "
        + BLEND.format("bl")
    )


#: Length scale of the similarity score by number of reference positions (published piecewise values).
D0 = "CASE WHEN len < 12 THEN 0.3 WHEN len < 16 THEN 0.4 WHEN len < 20 THEN 0.5 WHEN len < 24 THEN 0.6 WHEN len < 30 THEN 0.7 ELSE 0.6*sqrt(len-0.5)-2.5 END"


def tm_sql(pairs: str) -> str:
    shared = "px IS NOT NULL AND qx IS NOT NULL"
    return (
        f"WITH {pairs}, tl AS (SELECT target, structure, count(qx) AS len, {pair_sums(shared)} FROM pairs GROUP BY 1, 2), tr AS MATERIALIZED ({rotation_sql('tl', 'target, structure')}),"
        f" tp AS (SELECT target, structure, {MOVED}, qx, qy, qz FROM pairs JOIN (SELECT target, structure, {', '.join(f'r{i}' for i in range(9))}, t0, t1, t2 FROM tr) USING (target, structure)),"
        f" ts AS (SELECT target, structure, {_GAP} AS gap FROM tp)"
        f" SELECT target, structure, round(coalesce(sum(1 / (1 + gap*gap/(d0*d0))), 0) / max(len), 6) AS tm FROM (SELECT target, structure, len, {D0} AS d0 FROM tl) LEFT JOIN ts USING (target, structure) GROUP BY 1, 2"
    )


def examples_sql() -> str:
    """Each structure, and a bent copy, on the two first structures of its target."""
    moved = "x * 1.1 + sin(pos * 1.7 + structure) AS x, y * 0.9 AS y, z"
    both = lambda points, name: (
        f"{name}p AS (SELECT p.target, p.structure, n.structure AS reference, p.pos, p.x AS px, p.y AS py, p.z AS pz, q.x AS qx, q.y AS qy, q.z AS qz, true AS anchor FROM {points} p JOIN nat n ON n.target = p.target JOIN dense q ON q.structure = n.structure AND q.pos = p.pos),"
        f" {robust_sql(f'{name}p', 'structure, reference', name)}"
    )
    return (
        f"WITH {DENSE}, nat AS (SELECT target, structure FROM (SELECT DISTINCT target, structure, dense_rank() OVER (PARTITION BY target ORDER BY structure) AS k FROM dense) WHERE k <= 2), bent AS (SELECT target, structure, pos, {moved} FROM dense),"
        f" {both('dense', 'ea')}, {both('bent', 'eb')}, jn AS (SELECT structure, reference, pos, a.residual AS t_error, b.residual AS p_error FROM ea a JOIN eb b USING (structure, reference, pos)),"
        " ch AS (SELECT structure, arg_min(reference, (joint, reference)) AS reference FROM (SELECT structure, reference, avg(least(t_error, p_error)) AS joint FROM jn GROUP BY 1, 2) GROUP BY 1)"
        " SELECT structure, reference, pos, round(t_error, 6) AS t_error, round(p_error, 6) AS p_error, round(1 / (1 + exp(-least(greatest((t_error - p_error) / 1.5, -12), 12))), 6) AS label,"
        " round(0.25 + least(abs(t_error - p_error) / 5, 1), 6) AS weight FROM jn JOIN ch USING (structure, reference)"
    )
