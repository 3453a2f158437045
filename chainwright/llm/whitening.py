"""Embedding whitening by Jacobi-Davidson: the leading components of a covariance that is never formed.

Entries become whole numbers x = floor(64 c) + 1,000,000. The fit list holds each distinct x vector once. The solver sees the covariance only
through products with a block of vectors: each task centres its rows and adds up c (c u), so what is shuffled per product is one
block of d x k numbers per task, whatever the number of rows.

1. Rayleigh-Ritz in the subspace found so far gives the k leading Ritz pairs and their residuals.
2. Leading pairs whose residual is at rounding level are locked; the subspace stays orthogonal to them.
3. The projected correction equations (I - QQ')(V - theta I)(I - QQ') t = -r of all open pairs are solved roughly by ``INNER`` steps of
   MINRES, which share their products, and the corrections widen the subspace. Above ``WIDEST`` times k directions it restarts from its best Ritz
   vectors.
4. Once all are locked, a last Rayleigh-Ritz with fresh products orders them, and their residuals are tested once more.

The mean is split into its whole part, which is subtracted exactly, and a fraction, so centring loses no digits; sums and deviations are exact integers.

Odd input: a row whose vector is null or empty, or holds a null or a value that is not finite, is left out; zero vectors take part; vectors of
different lengths are whitened apart, each length with a fit list of its own; rows that repeat count once in the fit and each get a result; a null id stays
null; other columns pass through, and an output column replaces an input column of its name; a component without variance (below 1e-12 of the trace) does not
exist, so equal vectors get none; entries beyond 2^40 are clipped there; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainwright.llm.batches import append
from chainwright.session import stash

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: Rounding level: a residual below so much of the largest eigenvalue, times the root of the length, counts as zero.
PRECISION = 1e-14
INNER = 6
#: Directions of the subspace per wanted component before it restarts, and outer steps before giving up.
WIDEST, STEPS = 6, 60
#: Share of the trace below which a component has no variance.
NO_VARIANCE = 1e-12
SEED = 11
CHUNK_VALUES = 1 << 20


def scaled(vector: Column) -> Column:
    """The whole-number vector, null if the vector takes no part."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    limit = float(1 << 40)
    whole = F.transform(vector, lambda c: F.floor(F.least(F.greatest(c * SCALE, F.lit(-SCALE * limit)), F.lit(SCALE * limit))).cast("long") + SHIFT)
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad), whole)


@dataclass
class Whitening:
    """Mean and leading components of one fit list; ``whole`` + ``part`` / ``n`` is the mean, exactly."""

    n: int
    whole: np.ndarray
    part: np.ndarray
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    products: int = 0
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.part / self.n

    def deviations(self, x: np.ndarray) -> list[int]:
        """Exact sum of (n x - S)^2 of each row."""
        gap = x - self.whole
        if len(gap) and (int(np.abs(gap).max()) + 1) * self.n < int((2.0**62 / gap.shape[1]) ** 0.5):
            return ((self.n * gap - self.part) ** 2).sum(1).tolist()
        return [sum((self.n * int(g) - int(p)) ** 2 for g, p in zip(row, self.part, strict=True)) for row in gap]

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))


def _matrix(values: pa.Array, width: int) -> np.ndarray:
    return np.array(values.flatten(), np.int64).reshape(-1, width)


def _added(fit: DataFrame, width: int, work: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum of ``work``, which gives ``size`` numbers for a block of rows, over all rows."""
    rows = max(1, CHUNK_VALUES // width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            x = _matrix(b.column(0), width)
            for a in range(0, len(x), rows):
                part = work(x[a : a + rows])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["cell", "value"])

    found = fit.mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(size)
    out[np.array(found["cell"], np.int64)] = np.array(found["value"])
    return out


def _sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of rows and exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [0] * (width + 1)
        for b in batches:
            x = _matrix(b.column(0), width)
            totals = [t + s for t, s in zip(totals, [*x.sum(0).tolist(), len(x)], strict=True)]
        if totals[width]:
            from decimal import Decimal

            yield pa.RecordBatch.from_arrays([pa.array(range(width + 1), pa.int32()), pa.array(list(map(Decimal, totals)), pa.decimal128(28, 0))], ["cell", "value"])

    found = fit.mapInArrow(run, "cell int, value decimal(28,0)").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    by_cell = {r["cell"]: int(r["value"]) for r in found}
    return by_cell.get(width, 0), [by_cell.get(i, 0) for i in range(width)]


def _norms(a: np.ndarray) -> np.ndarray:
    return np.sqrt((a * a).sum(0))


def _orthonormal(new: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """Unit columns that span what ``new`` adds to the given orthonormal columns."""
    out = np.zeros((len(new), 0))
    for column in (new / np.maximum(_norms(new), 1e-300)).T:
        before = column
        for _ in range(3):
            for q in (*against, out):
                column = column - q @ (q.T @ column)
        size = np.linalg.norm(column)
        if size > 1e-10 * max(np.linalg.norm(before), 1e-300):
            column = column / size
            for q in (*against, out):
                column = column - q @ (q.T @ column)
            out = np.column_stack([out, column / np.linalg.norm(column)])
    return out


def minres(apply: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int, enough: float = 0.05) -> np.ndarray:
    """Solutions of symmetric systems, one per column, by so many steps of the minimal residual method."""
    beta = _norms(right)
    safe = lambda a: np.where(a == 0, 1.0, a)
    first = safe(beta)
    v, v_old = right / first, np.zeros_like(right)
    x, w, w_old = (np.zeros_like(right) for _ in range(3))
    eta, last = beta.copy(), np.zeros_like(beta)
    c = c_old = np.ones_like(beta)
    s = s_old = np.zeros_like(beta)
    for _ in range(steps):
        if (np.abs(eta) <= enough * first).all():
            break
        p = apply(v)
        alpha = (v * p).sum(0)
        p = p - alpha * v - last * v_old
        then = _norms(p)
        then = np.where(then <= 1e-14 * (np.abs(alpha) + last), 0.0, then)
        delta = c * alpha - c_old * s * last
        rho = np.sqrt(delta**2 + then**2)
        two, three = s * alpha + c_old * c * last, s_old * last
        c_old, s_old = c, s
        c, s = np.where(rho == 0, 1.0, delta / safe(rho)), np.where(rho == 0, 0.0, then / safe(rho))
        w_old, w = w, np.where(rho == 0, 0.0, (v - three * w_old - two * w) / safe(rho))
        x = x + c * eta * w
        eta = -s * eta
        v_old, v, last = v, np.where(then == 0, 0.0, p / safe(then)), then
    return x


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix of that length, unit eigenvectors as columns, and the norms of their residuals."""
    k = min(k, length)
    random = np.random.default_rng(SEED)
    locked = np.zeros((length, 0))
    basis, images = np.zeros((length, 0)), np.zeros((length, 0))
    new = random.standard_normal((length, min(length, k + 4)))
    level = 0.0
    for _ in range(STEPS):
        new = _orthonormal(new, locked, basis)
        if new.shape[1]:
            basis, images = np.column_stack([basis, new]), np.column_stack([images, product(new)])
        h = basis.T @ images
        theta, s = np.linalg.eigh((h + h.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        want = k - locked.shape[1]
        u, image = basis @ s, images @ s
        level = max(level, abs(theta[0])) if len(theta) else level
        left = image[:, :want] - u[:, :want] * theta[:want]
        left = left - locked @ (locked.T @ left)
        small = _norms(left) <= PRECISION * length**0.5 * level
        full = locked.shape[1] + basis.shape[1] == length
        done = int(np.argmin(small)) if not small.all() else want
        if full and not new.shape[1] and done < want:
            # all of the space is searched: only fresh products of the Ritz vectors can still take away rounding
            basis = _orthonormal(u, locked)
            images = product(basis)
            if (_norms(images[:, :want] - basis[:, :want] * theta[:want]) <= 100 * PRECISION * length**0.5 * level).all():
                done, u = want, basis
        locked = np.column_stack([locked, u[:, :done]])
        want -= done
        if not want:
            break
        basis, images = u[:, done:], image[:, done:]
        theta, left = theta[done:], left[:, done:]
        if basis.shape[1] + want > max(WIDEST * k, want + 8):
            basis, images = basis[:, : 2 * k], images[:, : 2 * k]
        inside = np.column_stack([locked, basis[:, :want]])

        def project(a: np.ndarray, q: np.ndarray = inside) -> np.ndarray:
            a = a - q @ (q.T @ a)
            return a - q @ (q.T @ a)

        if full:
            new = np.zeros((length, 0))
            continue
        rows = min(left.shape[1], want)
        new = minres(lambda t, m=theta[:rows]: project(product(t) - t * m), -project(left[:, :rows]), INNER)
        if not (_norms(new) > 0).any():
            new = random.standard_normal((length, want))
    else:
        raise ArithmeticError("residuals did not reach rounding level")
    images = product(locked)
    h = locked.T @ images
    theta, s = np.linalg.eigh((h + h.T) / 2)
    order = np.argsort(-theta, kind="stable")
    vectors, images = (locked @ s)[:, order], (images @ s)[:, order]
    return theta[order], vectors / _norms(vectors), _norms(images - vectors * theta[order])


def fit(x: DataFrame, k: int = COMPONENTS) -> dict[int, Whitening]:
    """One whitening for each length of the vectors in the only column ``x``."""
    lists = stash(x.where("x IS NOT NULL").groupBy("x").agg(F.count(F.lit(1)).alias("_rows")).select("x", F.size("x").alias("w")), "fit")
    out = {}
    for (width,) in sorted(lists.select("w").distinct().collect()):
        rows = lists.where(F.col("w") == width).select("x")
        n, sums = _sums(rows, width)
        model = Whitening(n, np.array([s // n for s in sums]), np.array([s % n for s in sums]), 0.0, np.zeros(0), np.zeros((width, 0)), np.zeros(0))
        model.trace = float(_added(rows, width, lambda m, o=model: (o.centred(m) ** 2).sum(0), width).sum()) / n
        if model.trace > 0:
            plain = Whitening(n, model.whole, model.part, 0.0, model.values, model.vectors, model.residuals)

            def product(u: np.ndarray, rows: DataFrame = rows, o: Whitening = plain, model: Whitening = model) -> np.ndarray:
                def work(m: np.ndarray) -> np.ndarray:
                    c = o.centred(m)
                    return (c.T @ (c @ u)).ravel()

                model.products += 1
                return _added(rows, len(u), work, u.size).reshape(u.shape) / o.n

            values, vectors, residuals = jacobi_davidson(product, width, k)
            some = values > NO_VARIANCE * model.trace
            model.values, model.vectors, model.residuals = values[some], vectors[:, some], residuals[some]
            model.identity_error = _identity_error(rows, width, model)
        out[width] = model
    return out


def _identity_error(rows: DataFrame, width: int, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity."""
    k = len(model.values)

    def work(m: np.ndarray) -> np.ndarray:
        y = model.project(m)
        return np.r_[(y.T @ y).ravel(), y.sum(0)]

    total = _added(rows, width, work, k * k + k) / model.n
    mean = total[k * k :]
    return float(np.abs(total[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max()) if k else 0.0


FIELDS = [
    T.StructField("n", T.LongType()),
    T.StructField("deviation", T.DecimalType(38, 0)),
    T.StructField("whitened", T.ArrayType(T.DoubleType())),
    T.StructField("explained", T.ArrayType(T.DoubleType())),
    T.StructField("identity_error", T.DoubleType()),
]


def apply(rows: DataFrame, models: dict[int, Whitening], column: str = "x") -> DataFrame:
    """Add ``n``, ``deviation``, ``whitened`` and ``explained`` (one value per component) and ``identity_error``; all null where the vector is."""

    def work(values: pa.Array) -> list[pa.Array]:
        from decimal import Decimal

        size = np.array(values.value_lengths().fill_null(0), np.int64)
        out: list[list] = [[None] * len(values) for _ in FIELDS]
        for width in sorted({int(w) for w in size if int(w) in models}):
            model, at = models[width], np.flatnonzero(size == width)
            x = _matrix(values.take(pa.array(at)), width)
            shares = (model.values / model.trace).tolist() if model.trace else []
            for i, d, y in zip(at.tolist(), model.deviations(x), model.project(x).tolist(), strict=True):
                for j, v in enumerate((model.n, Decimal(d), y, shares, model.identity_error)):
                    out[j][i] = v
        kinds = [pa.int64(), pa.decimal128(38, 0), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64()]
        return [pa.array(o, kind) for o, kind in zip(out, kinds, strict=True)]

    return append(rows, column, FIELDS, work, 8 * CHUNK_VALUES)


def whiten(df: DataFrame, vector: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """The rows that take part, with the columns of ``apply``, fitted on their distinct vectors."""
    given = df["`" + vector.replace("`", "``") + "`"].cast("array<double>")
    models = fit(df.select(scaled(given).alias("x")), k)
    named = df.withColumn("_whole", scaled(given)).where("_whole IS NOT NULL")
    return apply(named, models, "_whole").drop("_whole")


def op11_whitening(spark, folder: str) -> DataFrame:
    """Sixteen whitened components of every row of ``embeddings``."""
    rows = whiten(spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding"))
    each = rows.select("vec_id", "n", F.col("deviation").cast("long").alias("deviation"), "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("i", "c"))
    return each.select("vec_id", (F.col("i") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")
