"""Three-dimensional vector algebra on tuples of columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(source: str | None = None, suffix: str = "") -> Vec:
    """Columns x, y, z, optionally of a struct column or with a suffix."""
    return tuple(F.col(f"{source}.{a}" if source else f"{a}{suffix}") for a in "xyz")


def const(x: float, y: float, z: float) -> Vec:
    return F.lit(float(x)), F.lit(float(y)), F.lit(float(z))


def add(a: Vec, b: Vec) -> Vec:
    return tuple(p + q for p, q in zip(a, b))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b))


def scale(a: Vec, s: Column | float) -> Vec:
    return tuple(p * s for p in a)


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def pick(condition: Column, a: Vec, b: Vec) -> Vec:
    return tuple(F.when(condition, p).otherwise(q) for p, q in zip(a, b))


def resolved(a: Vec) -> Column:
    return a[0].isNotNull() & a[1].isNotNull() & a[2].isNotNull()


def staged(df, name: str, a: Vec):
    """Materialise a vector as columns, so that later uses do not repeat its expression."""
    df = df.withColumns({f"{name}_{axis}": p for axis, p in zip("xyz", a)})
    return df, tuple(F.col(f"{name}_{axis}") for axis in "xyz")


def angle(left: Vec, middle: Vec, right: Vec) -> Column:
    """Angle at ``middle`` in radians; NULL when a side has no length."""
    u, v = sub(left, middle), sub(right, middle)
    size = norm(u) * norm(v)
    cosine = F.when(size > 1e-8, dot(u, v) / size)
    return F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0)) + cosine * 0)


def torsion(a: Vec, b: Vec, c: Vec, d: Vec) -> Column:
    """Signed dihedral in [-pi, pi]; NULL when degenerate."""
    b0, b1, b2 = sub(b, a), sub(c, b), sub(d, c)
    size = norm(b1)
    unit = tuple(F.when(size > 1e-8, p / size).otherwise(p * 0) for p in b1)
    v = sub(b0, scale(unit, dot(b0, unit)))
    w = sub(b2, scale(unit, dot(b2, unit)))
    value = F.atan2(dot(cross(unit, v), w), dot(v, w))
    return F.when((norm(v) >= 1e-8) & (norm(w) >= 1e-8), value)


# ---------------------------------------------------------------- superposed deviation

AXES = "xyz"
STATISTICS = ["n", *[f"p{a}" for a in AXES], *[f"q{a}" for a in AXES], *[f"h{a}{b}" for a in AXES for b in AXES], "pp", "qq"]


def pair_statistics(p: Vec, q: Vec, total=F.sum) -> dict[str, Column]:
    """Sums that determine the optimal superposition; they add up, so they combine map-side and slide."""
    both = resolved(p) & resolved(q)
    of = lambda c: F.when(both, c)
    out = {"n": total(both.cast("long"))}
    for i, a in enumerate(AXES):
        out[f"p{a}"] = total(of(p[i]))
        out[f"q{a}"] = total(of(q[i]))
        for j, b in enumerate(AXES):
            out[f"h{a}{b}"] = total(of(p[i] * q[j]))
    out["pp"] = total(of(dot(p, p)))
    out["qq"] = total(of(dot(q, q)))
    return out


def let(values: dict[str, Column], body) -> Column:
    """Bind named values once inside an expression.

    A one-element array carries them into a lambda.  Unlike a chain of projected
    columns, the optimizer cannot expand the names into their definitions when it
    pushes filters down, so long formulas stay linear in size.
    """
    bound = F.array(F.struct(*[v.alias(k) for k, v in values.items()]))
    return F.get(F.transform(bound, body), F.lit(0))


#: Share of the spread of two point sets below which their deviation counts as zero.
NOISE = 1e-9


def with_rmsd(df, name: str = "rmsd", least: int = 3):
    """Root mean square deviation after the best proper rotation, from the sums of ``pair_statistics``.

    With H the centred cross-covariance and e1 >= e2 the leading eigenvalues of
    H'H (trigonometric form for a symmetric 3x3 matrix), the singular values are
    sqrt(e1), sqrt(e2) and the signed third det(H) / (s1 s2).
    """
    n = F.col("n")
    size = lambda s: F.col(s * 2) - sum((F.col(f"{s}{a}") * F.col(f"{s}{a}") for a in AXES), F.lit(0.0)) / n
    covariance = {f"{a}{b}": F.col(f"h{a}{b}") - F.col(f"p{a}") * F.col(f"q{b}") / n for a in AXES for b in AXES}
    covariance["g"] = size("p") + size("q")

    def gram(c):
        values = {a + b: sum((c[k + a] * c[k + b] for k in AXES), F.lit(0.0)) for a in AXES for b in AXES if a <= b}
        values["det"] = (
            c["xx"] * (c["yy"] * c["zz"] - c["yz"] * c["zy"])
            - c["xy"] * (c["yx"] * c["zz"] - c["yz"] * c["zx"])
            + c["xz"] * (c["yx"] * c["zy"] - c["yy"] * c["zx"])
        )
        values["t"] = (values["xx"] + values["yy"] + values["zz"]) / 3
        values["g"] = c["g"]
        return let(values, shifted)

    def shifted(m):
        values = {k + k: m[k + k] - m["t"] for k in AXES}
        values |= {k: m[k] for k in ("xy", "xz", "yz", "det", "t", "g")}
        return let(values, shape)

    def shape(m):
        off = m["xy"] * m["xy"] + m["xz"] * m["xz"] + m["yz"] * m["yz"]
        w = F.sqrt((m["xx"] * m["xx"] + m["yy"] * m["yy"] + m["zz"] * m["zz"] + off * 2) / 6)
        det = (
            m["xx"] * (m["yy"] * m["zz"] - m["yz"] * m["yz"])
            - m["xy"] * (m["xy"] * m["zz"] - m["yz"] * m["xz"])
            + m["xz"] * (m["xy"] * m["yz"] - m["yy"] * m["xz"])
        )
        return let({"w": w, "d": det, "det": m["det"], "t": m["t"], "g": m["g"]}, roots)

    def roots(m):
        r = F.when(m["w"] > 0, m["d"] / (m["w"] * m["w"] * m["w"]) / 2).otherwise(0.0)
        phi = F.acos(F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0))) / 3
        e1 = lambda v: v["t"] + v["w"] * 2 * F.cos(v["phi"])
        e3 = lambda v: v["t"] + v["w"] * 2 * F.cos(v["phi"] + 2 * math.pi / 3)
        singular = lambda v: let(
            {"s1": F.sqrt(F.greatest(e1(v), F.lit(0.0))), "s2": F.sqrt(F.greatest(v["t"] * 3 - e1(v) - e3(v), F.lit(0.0))), "det": v["det"], "g": v["g"]}, total
        )
        return let({"phi": phi, "w": m["w"], "t": m["t"], "det": m["det"], "g": m["g"]}, singular)

    def total(v):
        third = F.when(v["s1"] * v["s2"] > 0, v["det"] / (v["s1"] * v["s2"])).otherwise(0.0)
        left = v["g"] - (v["s1"] + v["s2"] + third) * 2
        # what is left of equal point sets is rounding noise
        return F.when(left < v["g"] * NOISE, 0.0).otherwise(left)

    square = let(covariance, gram) / n
    return df.withColumn(name, F.when(n >= least, F.sqrt(F.greatest(square, F.lit(0.0)))))


# ---------------------------------------------------------------- rotation

#: Newton steps to the largest root; it is reached from above, at worst by half the way a step.
ROOT_STEPS = 60
#: Share below which the largest cofactor counts as zero: the points of one side lie on a line, or do not spread at all.
LINE = 1e-10
_QUAD = "wxyz"


def _entry(a: str, b: str) -> str:
    return a + b if _QUAD.index(a) <= _QUAD.index(b) else b + a


def cofactor(m, a: str, b: str):
    """Signed minor of a symmetric 4x4 matrix, whose entries ``m`` gives by their two names."""
    rows, cols = [x for x in _QUAD if x != a], [x for x in _QUAD if x != b]
    at = lambda i, j: m(_entry(rows[i], cols[j]))
    minor = (
        at(0, 0) * (at(1, 1) * at(2, 2) - at(1, 2) * at(2, 1))
        - at(0, 1) * (at(1, 0) * at(2, 2) - at(1, 2) * at(2, 0))
        + at(0, 2) * (at(1, 0) * at(2, 1) - at(1, 1) * at(2, 0))
    )
    return minor if (_QUAD.index(a) + _QUAD.index(b)) % 2 == 0 else -minor


def with_rotation(df, name: str = "rigid"):
    """Best proper rotation and shift of p onto q from the sums of ``pair_statistics``: nine numbers by row, then three.

    The rotation is the unit quaternion at the largest eigenvalue of a symmetric 4x4 matrix of the cross-covariance.  The eigenvalue is
    found by Newton steps from an upper bound, the quaternion is the longest column of the adjugate of what is left.  Points on a line leave a
    turn about it open; the smallest turn is taken.
    """
    n = F.greatest(F.col("n"), F.lit(1)).cast("double")
    covariance = {a + b: F.col(f"h{a}{b}") - F.col(f"p{a}") * F.col(f"q{b}") / n for a in AXES for b in AXES}
    pairs = [a + b for i, a in enumerate(_QUAD) for b in _QUAD[i:]]

    def matrix(c):
        values = {
            "ww": c["xx"] + c["yy"] + c["zz"], "wx": c["yz"] - c["zy"], "wy": c["zx"] - c["xz"], "wz": c["xy"] - c["yx"],
            "xx": c["xx"] - c["yy"] - c["zz"], "xy": c["xy"] + c["yx"], "xz": c["zx"] + c["xz"],
            "yy": c["yy"] - c["xx"] - c["zz"], "yz": c["yz"] + c["zy"], "zz": c["zz"] - c["xx"] - c["yy"],
        }
        values["size"] = sum((c[a + b] * c[a + b] for a in AXES for b in AXES), F.lit(0.0))
        values["det"] = (
            c["xx"] * (c["yy"] * c["zz"] - c["yz"] * c["zy"])
            - c["xy"] * (c["yx"] * c["zz"] - c["yz"] * c["zx"])
            + c["xz"] * (c["yx"] * c["zy"] - c["yy"] * c["zx"])
        )
        values |= {f"s{a}{b}": c[a + b] for a in AXES for b in AXES if a <= b}
        return let(values, root)

    def root(m):
        last = sum((m[_entry("w", x)] * cofactor(lambda k: m[k], "w", x) for x in _QUAD), F.lit(0.0))

        def climb(v):
            def step(at, _):
                slope = at * (at * at * 4 - m["size"] * 4) - m["det"] * 8
                value = at * (at * (at * at - m["size"] * 2) - m["det"] * 8) + v["last"]
                return F.when(slope > 0, at - value / slope).otherwise(at)

            top = F.aggregate(F.sequence(F.lit(1), F.lit(ROOT_STEPS)), F.sqrt(m["size"] * 3), step)
            kept = {k: m[k] for k in ("size", "sxx", "sxy", "sxz", "syy", "syz", "szz", "ww", "wx", "wy", "wz")}
            return let({f"m{k}": m[k] for k in pairs} | kept | {"top": top}, less)

        return let({"last": last}, climb)

    def less(v):
        of = {f"m{k}": v[f"m{k}"] - v["top"] if k[0] == k[1] else v[f"m{k}"] for k in pairs}
        return let(of | {k: v[k] for k in ("size", "sxx", "sxy", "sxz", "syy", "syz", "szz", "ww", "wx", "wy", "wz")}, columns)

    def columns(v):
        c = {f"c{k}": cofactor(lambda e: v[f"m{e}"], k[0], k[1]) for k in pairs}
        return let(c | {k: v[k] for k in ("size", "sxx", "sxy", "sxz", "syy", "syz", "szz", "ww", "wx", "wy", "wz")}, choose)

    def choose(v):
        size = F.sqrt(v["size"])
        largest = F.greatest(*[F.abs(v["c" + 2 * k]) for k in _QUAD])
        column = lambda k: F.array(*[v["c" + _entry(k, x)] for x in _QUAD])
        # p and q on lines: half way from one direction to the other; opposite ones turn about an axis across
        half = F.array(size + v["ww"], v["wx"], v["wy"], v["wz"])
        across = {
            "x": F.array(F.lit(0.0), size + v["sxx"], v["sxy"], v["sxz"]),
            "y": F.array(F.lit(0.0), v["sxy"], size + v["syy"], v["syz"]),
            "z": F.array(F.lit(0.0), v["sxz"], v["syz"], size + v["szz"]),
        }
        least = F.least(*[F.abs(v[f"s{a}{a}"]) for a in AXES])
        turned = F.when(F.abs(v["sxx"]) == least, across["x"]).when(F.abs(v["syy"]) == least, across["y"]).otherwise(across["z"])
        line = F.when(size + v["ww"] > size * 1e-9, half).otherwise(turned)
        picked = F.when(v["size"] <= 0, F.array(*[F.lit(float(k == "w")) for k in _QUAD])).when(largest <= v["size"] * size * LINE, line)
        for k in _QUAD[:-1]:
            picked = picked.when(F.abs(v["c" + 2 * k]) == largest, column(k))
        return let({"c": picked.otherwise(column("z"))}, unit)

    def unit(v):
        c = [F.get(v["c"], F.lit(i)) for i in range(4)]
        length = F.sqrt(sum((x * x for x in c), F.lit(0.0)))
        return let({k: x / length for k, x in zip(_QUAD, c)}, turn)

    def turn(v):
        w, x, y, z = (v[k] for k in _QUAD)
        return F.array(
            w * w + x * x - y * y - z * z, (x * y - w * z) * 2, (x * z + w * y) * 2,
            (x * y + w * z) * 2, w * w - x * x + y * y - z * z, (y * z - w * x) * 2,
            (x * z - w * y) * 2, (y * z + w * x) * 2, w * w - x * x - y * y + z * z,
        )

    turned = df.withColumn(name, let(covariance, matrix))
    r = lambda i, j: F.get(name, F.lit(3 * i + j))
    shift = [(F.col(f"q{a}") - sum((r(i, j) * F.col(f"p{b}") for j, b in enumerate(AXES)), F.lit(0.0))) / n for i, a in enumerate(AXES)]
    return turned.withColumn(name, F.concat(F.col(name), F.array(*shift)))
