"""Embedding whitening: leading eigenvectors of the covariance by a block Jacobi-Davidson method.

Vectors become integers (``QUANTUM`` steps a unit), so that counts, sums and deviations are exact. The covariance is taken over
the distinct integer vectors, which are stored once as packed blocks. It is never formed: what the solver needs are products of the
covariance with a few columns, and each is one pass over the blocks, in which a task centres its vectors, multiplies twice and
sends one column sum per entry; Spark adds them up.

The solver keeps a search space of few columns with their products. A Rayleigh-Ritz step gives the largest eigenvalues within the
space; pairs whose residual reaches double precision are locked, in order. For the next ones the correction equation

    (I - Q Q') (V - t I) (I - Q Q') z = -r,    Q = the locked vectors and the pair's own,

is solved approximately by MINRES. The equations of a block run in step, so that an inner step of all of them costs one pass. The
corrections are made orthogonal and join the space, which shrinks to the best Ritz vectors when it is full.

Handling: a vector that is null, empty or holds a null or a number that is not finite is dropped; so is one of another length than most
vectors have (ties: the longer). Repeated rows and null ids are rows of their own; they count once among the vectors the covariance
is made of. Entries too large for a 64-bit integer are taken at its end; a deviation that needs more is null. Directions without
variance have no component, so one vector alone, or an empty table, gives no rows. Further columns do not come back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, slices, table

QUANTUM, SHIFT = 64.0, 1_000_000
COMPONENTS = 16
#: Columns that join the search space at a time, and how many spaces of them it holds before it shrinks.
BLOCK, BLOCKS_HELD = 16, 6
INNER_STEPS = 6
OUTER_STEPS = 300
#: A residual of this share of the largest eigenvalue is double precision: rounding of sums over many rows leaves as much.
PRECISION = 64 * np.finfo(float).eps
#: Eigenvalues below this share of the largest are rounding errors of zero.
ZERO = 1e-13
#: Vectors in a packed block.
PACK = 2048
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


# ---------------------------------------------------------------- vectors

def quantised(vectors: DataFrame, column: str) -> DataFrame:
    """``vectors`` without unusable rows, with ``x``: little-endian 64-bit integers of one length."""
    at = F.col(column)
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    usable = vectors.filter(at.isNotNull() & (F.size(at) > 0)).withColumn(column, at.cast("array<double>")).filter(F.forall(column, finite))
    sizes = usable.groupBy(F.size(at).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    best = sizes.agg(F.max(F.struct("n", "d")).alias("m")).first()["m"]
    usable = usable.filter(F.size(at) == (best["d"] if best else 0))
    places = usable.columns.index(column)
    from pyspark.sql.types import BinaryType, StructField, StructType

    schema = StructType([StructField("x", BinaryType()) if k == places else f for k, f in enumerate(usable.schema.fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if batch.num_rows:
                lists = batch.column(places)
                c = lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                scaled = np.floor(QUANTUM * c)
                # the largest double below 2 ** 63, less the shift, keeps the sum in range
                x = np.clip(scaled, -(2.0**62), 2.0**62).astype(np.int64) + SHIFT
                rows = x.astype("<i8").tobytes()
                size = x.shape[1] * 8
                packed = pa.array([rows[k : k + size] for k in range(0, len(rows), size)], type=pa.binary())
                yield pa.RecordBatch.from_arrays([packed if k == places else a for k, a in enumerate(batch.columns)], names=schema.names)

    return usable.mapInArrow(run, schema)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of packed vectors as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<i8").reshape(len(column), -1)


def packed(distinct: DataFrame) -> DataFrame:
    """block binary, rows int: up to PACK vectors end to end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PACK):
                part = batch.column(0).slice(at, PACK)
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(part.to_pylist())], type=pa.binary()), pa.array([len(part)], type=pa.int32())], names=["block", "rows"])

    return distinct.select("x").mapInArrow(run, "block binary, rows int")


class Fit:
    """The distinct vectors as stored blocks, with their number and sums."""

    def __init__(self, blocks: DataFrame):
        self.blocks = blocks
        self.n = int(blocks.agg(F.sum("rows")).first()[0] or 0)
        first = blocks.select((F.length("block") / F.col("rows") / 8).cast("int")).head()
        self.d = first[0] if first else 0
        self.sums = [0] * self.d
        if self.n:
            self.sums = [int(s) for s in self.total(lambda x: [int(s) for s in x.astype(object).sum(axis=0)] if np.abs(x).max() > 2**40 else x.sum(axis=0).tolist(), "decimal(38,0)")]

    def total(self, of_block: Callable[[np.ndarray], list], kind: str = "double") -> list:
        """The sums over all blocks of a list of numbers that a function makes of each block. A task adds up its own blocks."""
        exact = kind != "double"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            have = None
            for batch in batches:
                for block, rows in zip(batch.column(0), batch.column(1)):
                    x = np.frombuffer(block.as_buffer(), dtype="<i8").reshape(rows.as_py(), -1)
                    new = of_block(x)
                    have = new if have is None else [a + b for a, b in zip(have, new)] if exact else have + new
            if have is not None:
                values = pa.array([str(v) for v in have]) if exact else pa.array(np.asarray(have, dtype=float))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(have), dtype=np.int32)), values], names=["at", "v"])

        parts = self.blocks.mapInArrow(run, f"at int, v {'string' if exact else 'double'}")
        rows = parts.groupBy("at").agg(F.sum(F.col("v").cast(kind)).alias("v")).collect()  # one row per entry of the list
        return [r["v"] for r in sorted(rows, key=lambda r: r["at"])]

    def products(self, columns: np.ndarray) -> np.ndarray:
        """The covariance times some columns: one pass."""
        n, sums = self.n, self.sums

        def of_block(x):
            c = centred(x, n, sums)
            return (c.T @ (c @ columns)).ravel()

        return np.array(self.total(of_block)).reshape(columns.shape) / self.n

    def trace(self) -> float:
        n, sums = self.n, self.sums
        return self.total(lambda x: np.array([np.square(centred(x, n, sums)).sum()]))[0] / self.n

    def spread(self, project: np.ndarray) -> np.ndarray:
        """The covariance of the vectors projected on some columns, from their own mean."""
        n, sums, k = self.n, self.sums, project.shape[1]

        def of_block(x):
            w = centred(x, n, sums) @ project
            return np.concatenate(((w.T @ w).ravel(), w.sum(axis=0)))

        got = np.array(self.total(of_block)) / self.n
        mean = got[k * k :]
        return got[: k * k].reshape(k, k) - np.outer(mean, mean)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x less the mean: the whole part of the mean is taken off exactly before anything is rounded."""
    whole = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - whole) - rest


# ---------------------------------------------------------------- the solver

def orthonormal(z: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """Columns that span what ``z`` adds to the spaces of the others; directions that add nothing are left out."""
    norms = np.linalg.norm(z, axis=0)
    z = z[:, norms > 0] / norms[norms > 0]
    for _ in range(2):
        for q in against:
            if q.shape[1]:
                z = z - q @ (q.T @ z)
        if not z.shape[1]:
            return z
        u, s, _ = np.linalg.svd(z, full_matrices=False)
        z = u[:, s > 1e-10 * max(1.0, s[0])] if s[0] > 1e-10 else z[:, :0]
    return z


def minres(product: Callable[[np.ndarray], np.ndarray], shift: np.ndarray, locked: np.ndarray, own: np.ndarray, rhs: np.ndarray, steps: int, tolerance: float) -> np.ndarray:
    """Corrections for a block of pairs, one equation a column, by MINRES in step: each step multiplies all directions in one pass."""

    def project(z):
        z = z - locked @ (locked.T @ z) if locked.shape[1] else z
        return z - own * (own * z).sum(axis=0)

    dot = lambda a, b: (a * b).sum(axis=0)
    safe = lambda a: np.where(np.abs(a) > 1e-300, a, 1.0)
    v = project(rhs)
    beta = np.sqrt(dot(v, v))
    live = beta > 0
    v = v / safe(beta)
    before, d1, d2, z = np.zeros_like(v), np.zeros_like(v), np.zeros_like(v), np.zeros_like(v)
    # Givens rotations of the last two steps; eta is what is left of the right side
    c0, c1, s0, s1 = np.ones(len(beta)), np.ones(len(beta)), np.zeros(len(beta)), np.zeros(len(beta))
    eta, first, old_beta = beta.copy(), beta.copy(), np.zeros(len(beta))
    for _ in range(steps):
        w = project(product(v) - v * shift)
        alpha = dot(v, w)
        w = w - alpha * v - old_beta * before
        beta = np.sqrt(dot(w, w))
        delta, r3, r2 = c1 * alpha - c0 * s1 * old_beta, s0 * old_beta, s1 * alpha + c0 * c1 * old_beta
        r1 = np.hypot(delta, beta)
        live &= r1 > 1e-300
        c0, s0, c1, s1 = c1, s1, delta / safe(r1), beta / safe(r1)
        d = (v - r3 * d1 - r2 * d2) / safe(r1)
        z = np.where(live, z + c1 * eta * d, z)
        eta = -s1 * eta
        d1, d2, before, v, old_beta = d2, d, v, w / safe(beta), beta
        live &= (beta > 1e-300) & (np.abs(eta) > tolerance * first)
        if not live.any():
            break
    return project(z)


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], d: int, k: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and their vectors, of the symmetric operator behind ``product``."""
    k = min(k, d)
    block = min(BLOCK, d)
    locked, values = np.zeros((d, 0)), []
    space = orthonormal(np.random.default_rng(seed).standard_normal((d, block)))
    image = product(space)
    scale, worst, still = 0.0, np.inf, 0
    for outer in range(OUTER_STEPS):
        h = space.T @ image
        theta, y = np.linalg.eigh((h + h.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        scale = max(scale, theta[0] if not values else values[0])
        ritz, moved = space @ y, image @ y
        residual = moved - ritz * theta
        residual = residual - locked @ (locked.T @ residual)
        norms = np.linalg.norm(residual, axis=0)
        # lock from the top on, as long as residuals are small
        complete = space.shape[1] + locked.shape[1] >= d
        good = 0
        while good < len(theta) and len(values) + good < k and norms[good] <= PRECISION * max(scale, 1e-300):
            good += 1
        wanted = norms[: k - len(values)]
        # rounding may leave residuals just above the bound; what no longer shrinks there is as exact as it gets
        still = still + 1 if wanted.max(initial=0) >= 0.5 * worst else 0
        worst = min(worst, wanted.max(initial=0))
        if not good and (complete or still >= 4) and (wanted <= 1000 * PRECISION * max(scale, 1e-300)).all():
            good = min(k - len(values), len(theta))
        if good:
            locked = np.concatenate((locked, ritz[:, :good]), axis=1)
            values += theta[:good].tolist()
            still, worst = 0, np.inf
            if len(values) >= k:
                break
        theta, ritz, moved, residual = theta[good:], ritz[:, good:], moved[:, good:], residual[:, good:]
        m = min(block, k - len(values) + 2, ritz.shape[1])
        if ritz.shape[1] + block > BLOCKS_HELD * block:  # keep the best of the space
            ritz, moved, theta, residual = ritz[:, : 2 * block], moved[:, : 2 * block], theta[: 2 * block], residual[:, : 2 * block]
        if m:
            z = minres(product, theta[:m], locked, ritz[:, :m], -residual[:, :m], INNER_STEPS, 0.5 ** min(outer + 1, 30))
            z = orthonormal(z, locked, ritz)
        else:
            z = np.zeros((d, 0))
        if not z.shape[1]:  # the space cannot grow by corrections: by any direction that is left
            z = orthonormal(np.random.default_rng(seed + outer + 1).standard_normal((d, min(block, max(1, d - locked.shape[1] - ritz.shape[1])))), locked, ritz)
        if z.shape[1] and still < 2:
            space, image = np.concatenate((ritz, z), axis=1), np.concatenate((moved, product(z)), axis=1)
        else:  # products are made again, without what rounding has left in them
            space = orthonormal(np.concatenate((ritz, z), axis=1), locked)
            image = product(space)
    else:
        raise ArithmeticError(f"{len(values)} of {k} eigenvectors after {OUTER_STEPS} steps")
    # a last step within the locked vectors: neighbours may have been locked in the wrong order
    locked = orthonormal(locked)
    image = product(locked)
    theta, y = np.linalg.eigh((locked.T @ image + image.T @ locked) / 2)
    theta, y = theta[::-1], y[:, ::-1]
    left = np.linalg.norm(image @ y - locked @ y * theta, axis=0).max()
    if left > 1000 * PRECISION * max(scale, 1e-300):
        raise ArithmeticError(f"a residual of {left:.3g} at the largest eigenvalue {scale:.3g}")
    return theta, locked @ y


# ---------------------------------------------------------------- the operator

def whiten(vectors: DataFrame, id_column: str, column: str, components: int = COMPONENTS) -> DataFrame:
    """A row per usable vector and component: see RESULT."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "whitening")
    named = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).alias("x"))
    rows = scratch.store("rows", quantised(named, "x"))
    blocks = scratch.store("blocks", packed(rows.select("x").distinct()))
    fit = Fit(blocks)
    if fit.n < 2:
        return spark.createDataFrame([], RESULT)
    values, axes = jacobi_davidson(fit.products, fit.d, components)
    trace = fit.trace()
    some = values > ZERO * max(values[0], 0) if trace > 0 else values > np.inf
    values, axes = values[some], axes[:, some]
    if not len(values):
        return spark.createDataFrame([], RESULT)
    project = axes / np.sqrt(values)
    error = float(np.abs(fit.spread(project) - np.eye(len(values))).max())
    scratch.drop("blocks")
    n, sums, k = fit.n, fit.sums, len(values)
    explained = values / trace
    names = [c.split()[0] for c in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PACK):
                part = batch.slice(at, PACK)
                x = matrix(part.column(1))
                m = len(x)
                w = centred(x, n, sums) @ project
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                    pa.array(deviations(x, n, sums), type=pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(w.ravel()),
                    pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ], names=names)

    return rows.select("vec_id", "x").mapInArrow(run, RESULT)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S) squared, exactly; None where it is no 64-bit integer."""
    top = max(n * max(int(x.max()), 0) + max(map(abs, sums)), n * -min(int(x.min()), 0) + max(map(abs, sums)))
    if top < 1 << 62:
        away = n * x - np.array(sums, dtype=np.int64)
        if int(np.abs(away).max()) ** 2 * x.shape[1] < 1 << 63:
            return np.square(away).sum(axis=1).tolist()
    away = x.astype(object) * n - np.array(sums, dtype=object)
    return [s if s < 1 << 63 else None for s in (away * away).sum(axis=1).tolist()]


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
