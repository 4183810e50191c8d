"""Embedding whitening by Jacobi-Davidson.

The covariance is never formed: its product with a block of vectors is one distributed pass of centred products over the stored fit list,
and partitions send sums of the size of the block. A search space of such vectors gives Ritz pairs; each pair that has not converged is
corrected by its projected equation, solved roughly by MINRES, all pairs in step so that an inner step is one pass as well. Leading pairs are
locked once their residual is at rounding level.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stager, table
from .vectors import finite, on_grid_rows, summed, unpack, usual_length

#: Steps per unit of the grid. The contract adds 1,000,000 to every entry, which cancels in every value that is returned.
SCALE = 64
COMPONENTS = 16
#: Ritz pairs that are improved beside the wanted ones, inner steps at most, outer rounds at most.
EXTRA, INNER, ROUNDS = 4, 5, 200
#: A residual of so many roundings of the largest eigenvalue is at double precision.
ROUNDINGS = 16.0
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def orthonormal(new: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """A basis of what ``new`` adds to the orthonormal columns of ``against``; directions that only rounding left are dropped."""
    norms = np.linalg.norm(new, axis=0)
    kept: list[np.ndarray] = []
    for column in (new[:, norms > 0] / norms[norms > 0]).T:
        for _ in range(3):  # projecting repeatedly takes out what cancellation left
            for basis in against:
                column = column - basis @ (basis.T @ column)
            for other in kept:
                column = column - other * (other @ column)
            length = np.linalg.norm(column)
            if length < 1e-10:
                break
            column = column / length
        else:
            kept.append(column)
    return np.array(kept).T if kept else np.zeros((len(new), 0))


def minres(product: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int, enough: float = 0.05) -> np.ndarray:
    """Approximate solutions of one symmetric system per column, all columns a step at a time.

    Lanczos vectors of every column are rotated into the minimal residual as they come; it ends when all residuals are ``enough`` of the start.
    """
    tiny = np.finfo(float).tiny
    start = np.linalg.norm(right, axis=0)
    beta, last_beta = start.copy(), np.ones_like(start)
    before, now = np.zeros_like(right), right / np.maximum(start, tiny)
    solution, old, older = np.zeros_like(right), np.zeros_like(right), np.zeros_like(right)
    cos, sin, last_cos, last_sin = np.ones_like(start), np.zeros_like(start), np.ones_like(start), np.zeros_like(start)
    left = start.copy()
    for step in range(steps):
        image = product(now) - (before * beta if step else 0)
        alpha = (now * image).sum(axis=0)
        image = image - now * alpha
        next_beta = np.linalg.norm(image, axis=0)
        # The new column of the tridiagonal matrix under the two rotations before it, then its own rotation.
        above = beta if step else np.zeros_like(beta)
        third, second = last_sin * above, last_cos * above
        second, first = cos * second + sin * alpha, -sin * second + cos * alpha
        size = np.maximum(np.hypot(first, next_beta), tiny)
        last_cos, last_sin, cos, sin = cos, sin, first / size, next_beta / size
        direction = (now - old * second - older * third) / size
        solution = solution + direction * (cos * left)
        left = -sin * left
        older, old = old, direction
        going = next_beta > 1e-14 * np.maximum(last_beta, start)
        before, now = now, np.where(going, image / np.maximum(next_beta, tiny), 0.0)
        last_beta, beta = beta, next_beta
        if (np.abs(left) <= enough * start).all():
            break
    return solution


def leading_eigenpairs(
    product: Callable[[np.ndarray], np.ndarray], size: int, wanted: int, extra: int = EXTRA, inner: int = INNER, rounds: int = ROUNDS, seed: int = 7,
) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and unit eigenvectors (size, wanted) of a symmetric matrix known by its products."""
    wanted = min(wanted, size)
    block = min(size, wanted + extra)
    most = min(size, 4 * block)
    random = np.random.default_rng(seed)
    locked, values = np.zeros((size, 0)), np.zeros(0)
    space = orthonormal(random.standard_normal((size, block)))
    image = product(space)
    for _ in range(rounds):
        small = space.T @ image
        ritz, turn = np.linalg.eigh((small + small.T) / 2)
        turn, ritz = turn[:, ::-1], ritz[::-1]
        space, image = space @ turn, image @ turn
        residual = image - space * ritz
        residual -= locked @ (locked.T @ residual)
        scale = max(np.abs(ritz).max(initial=0.0), np.abs(values).max(initial=0.0))
        fine = np.linalg.norm(residual, axis=0) <= ROUNDINGS * np.finfo(float).eps * np.sqrt(size) * scale
        if locked.shape[1] + space.shape[1] == size:
            fine[:] = True  # the search space is everything: what is left is rounding
        done = len(fine) if fine.all() else int(fine.argmin())
        locked, values = np.concatenate([locked, space[:, :done]], axis=1), np.concatenate([values, ritz[:done]])
        if locked.shape[1] >= wanted:
            order = np.argsort(-values, kind="stable")[:wanted]
            return values[order], locked[:, order]
        space, image, residual, ritz = space[:, done:], image[:, done:], residual[:, done:], ritz[done:]
        if space.shape[1] + block > most and locked.shape[1] + space.shape[1] + block < size:
            keep = min(2 * block, space.shape[1])
            space = space[:, :keep]
            image = product(space)  # fresh products take out what repeated turns have rounded
            residual = residual[:, :keep]
        aim = min(block, space.shape[1])
        near, shift, out = space[:, :aim], ritz[:aim], [locked, space[:, :aim]]

        def projected(x: np.ndarray) -> np.ndarray:
            for basis in out:
                x = x - basis @ (basis.T @ x)
            return x

        def equation(x: np.ndarray) -> np.ndarray:
            x = projected(x)
            return projected(product(x) - x * shift)

        fresh = orthonormal(minres(equation, projected(-residual[:, :aim]), inner), locked, space)
        if fresh.shape[1] < min(aim, size - locked.shape[1] - space.shape[1]):
            fresh = np.concatenate([fresh, orthonormal(random.standard_normal((size, aim)), locked, space, fresh)], axis=1)
        fresh = fresh[:, :min(aim, size - locked.shape[1] - space.shape[1])]
        space, image = np.concatenate([space, fresh], axis=1), np.concatenate([image, product(fresh)], axis=1)
    raise ArithmeticError(f"{locked.shape[1]} of {wanted} eigenpairs reached double precision in {rounds} rounds")


def on_grid(vectors: DataFrame, key: str, vector: str, size: int, scale: int = SCALE) -> DataFrame:
    """(id, x): floor(scale * c) of every entry c, packed; rows that :func:`finite` refuses or of another length take no part."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(finite(F.col("v")) & (F.size("v") == size))
    return on_grid_rows(rows, scale, ["id"])


class CentredProducts:
    """Products with the covariance of a stored fit list of packed rows, each one pass over it."""

    def __init__(self, fit: DataFrame, size: int):
        self.fit, self.size = fit, size
        # Halves of the numbers, so that no sum overflows.
        total = summed(fit, lambda batches: sum(
            (np.concatenate([[[len(x)] + [0] * (size - 1)], [(x >> 31).sum(axis=0)], [(x & 0x7FFFFFFF).sum(axis=0)]]) for x in (unpack(b.column("x"), size) for b in batches)),
            np.zeros((3, size), "int64")))
        self.n = int(total[0, 0])
        sums = [(int(h) << 31) + int(low) for h, low in zip(total[1], total[2], strict=True)]
        #: The mean in two parts: the nearest integer and the rest, which is at most a half.
        self.whole = np.array([(2 * s + self.n) // (2 * self.n) for s in sums], "int64")
        self.left = [s - self.n * int(m) for s, m in zip(sums, self.whole, strict=True)]
        self.sums = sums

    def centring(self) -> Callable[[np.ndarray], np.ndarray]:
        whole, rest = self.whole, np.array([s / self.n for s in self.left])
        return lambda grid: (grid - whole) - rest

    def __call__(self, block: np.ndarray) -> np.ndarray:
        size, centred = self.size, self.centring()

        def part(batches):
            total = np.zeros(block.shape)
            for b in batches:
                x = centred(unpack(b.column("x"), size))
                total += x.T @ (x @ block)
            return total

        return summed(self.fit, part) / self.n

    def check(self, to_white: np.ndarray) -> tuple[float, float]:
        """(trace of the covariance, largest absolute entry of the covariance of the whitened fit list minus the identity)."""
        size, centred, k = self.size, self.centring(), to_white.shape[1]

        def part(batches):
            total = np.zeros((k + 2, max(size, k)))
            for b in batches:
                x = centred(unpack(b.column("x"), size))
                z = x @ to_white
                total[:k, :k] += z.T @ z
                total[k, :k] += z.sum(axis=0)
                total[k + 1, :size] += (x * x).sum(axis=0)
            return total

        total = summed(self.fit, part) / self.n
        mean = total[k, :k]
        return float(total[k + 1, :size].sum()), float(np.abs(total[:k, :k] - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def deviations(grid: np.ndarray, n: int, whole: np.ndarray, left: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - S)^2 for every row, exact; null where it does not fit into a long."""
    near = grid - whole
    bound = n * (int(np.abs(near).max(initial=0)) + 1)
    if bound * bound * grid.shape[1] < 1 << 63:
        return ((near * n - np.array(left, "int64")) ** 2).sum(axis=1).tolist()
    exact = ((near.astype(object) * n - np.array(left, object)) ** 2).sum(axis=1).tolist()
    return [x if x < 1 << 63 else None for x in exact]


def whiten(spark: SparkSession, vectors: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row (vec_id, component, n, deviation, whitened, explained, identity_error) per usable row of ``vectors`` and leading component.

    Vectors that are null, empty, or hold null or non-finite entries take no part, nor do those of another length than most. Rows that repeat,
    also by id or with a null id, are rows of their own in the result; the fit list holds every distinct vector of the grid once. Entries beyond
    2^53 steps of the grid are held there. Components whose eigenvalue is at rounding level (a constant table, fewer distinct vectors than
    components) have no whitened value and are left out; no usable row gives no rows. Other columns of ``vectors`` are ignored.
    """
    stage = Stager(spark)
    v = F.col(vector).cast("array<double>")
    size = usual_length(vectors.select(v.alias("v")).where(finite(F.col("v"))), "v")
    if not size:
        return spark.createDataFrame([], SCHEMA)
    rows = stage(on_grid(vectors, key, vector, size), "grid")
    covariance = CentredProducts(stage(rows.select("x").distinct(), "fit"), size)
    values, axes = leading_eigenpairs(covariance, size, components)
    sound = values > 64 * np.finfo(float).eps * size * max(values.max(initial=0.0), np.finfo(float).tiny)
    values, axes = values[sound], axes[:, sound]
    if not len(values):
        return spark.createDataFrame([], SCHEMA)
    to_white = axes / np.sqrt(values)
    trace, error = covariance.check(to_white)
    n, k, whole, left, centred, explained = covariance.n, len(values), covariance.whole, covariance.left, covariance.centring(), values / trace

    def run(batches):
        for whole_batch in batches:
            for start in range(0, whole_batch.num_rows, 4_096):
                b = whole_batch.slice(start, 4_096)
                grid = unpack(b.column("x"), size)
                m = len(grid)
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.record_batch({
                    "vec_id": b.column("id").take(each), "component": pa.array(np.tile(np.arange(1, k + 1, dtype="int32"), m)),
                    "n": pa.array(np.full(m * k, n)), "deviation": pa.array(deviations(grid, n, whole, left), pa.int64()).take(each),
                    "whitened": pa.array((centred(grid) @ to_white).ravel()), "explained": pa.array(np.tile(explained, m)),
                    "identity_error": pa.array(np.full(m * k, error)),
                })

    return rows.mapInArrow(run, SCHEMA)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark, table(spark, sf_dir, "embeddings"))
