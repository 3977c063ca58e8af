"""Whitening of embeddings by a Jacobi-Davidson iteration over distributed products.

Vectors become whole numbers, and each distinct vector counts once. Sums are exact, so a vector is centred without loss: a whole number
near the mean is taken off first, then what is left of the mean (less than one). The covariance is never formed: a product with a block of directions is one pass over the
vectors, in which a task adds what its vectors give, and the tasks' sums meet in ``MEET`` tasks before they reach the driver.

*Iteration.* A search space gives Ritz pairs (Rayleigh-Ritz on a small matrix). For every wanted pair that is not yet exact, MINRES solves the correction
equation, projected on what is orthogonal to all wanted Ritz vectors; the equations advance side by side, so an inner step of all of them is one pass. Their
solutions enlarge the space; pairs whose residual reaches double precision are locked and need no more corrections. It ends when all wanted pairs are locked.

The driver holds some dozens of directions (numbers by dimension), never vectors of the table.

Results in odd cases: rows whose vector is null, empty, or has a null or non-finite entry are left out, and so are those with an entry beyond 2 ** 40, which
doubles don't hold exactly, and those whose length is not the most frequent one (of several, the smallest); a null ``vec_id`` stays null, rows that repeat are returned each; components that carry less than
1e-10 of the first one's variance are left out, so one distinct vector, or an empty table, gives no rows; ties of eigenvalues give any basis of
their space; a deviation that does not fit 64 bits is null; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.llm.shared import written

#: Tasks in which the sums of all tasks meet.
MEET = 8
#: Bytes of the vectors that are worked on at once.
CHUNK_BYTES = 1 << 21
#: Residual of a locked pair, as a share of the largest eigenvalue.
EXACT = 64 * np.finfo(float).eps
#: Directions besides the wanted ones that a search space starts with, inner steps of a correction, and directions (times the wanted ones) at which the space starts anew.
SPARE, STEPS, LARGEST = 8, 8, 6
LEAST_SHARE = 1e-10


@dataclass(frozen=True)
class Whitening:
    """What ``applied`` needs: the exact mean (``total / n``), unit directions as columns, their variances, and the measures of the fit."""

    n: int
    total: list[int]
    directions: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float

    def near(self) -> np.ndarray:
        """Whole numbers nearest to the mean."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.total], np.int64)

    def rest(self) -> np.ndarray:
        """The mean less those."""
        return np.array([(s - self.n * int(r)) / self.n for s, r in zip(self.total, self.near(), strict=True)])


def whole(embeddings: DataFrame, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """``vec_id`` and ``x``, whole numbers floor(scale * c) + shift, of the rows that take part; written."""
    c = F.transform("embedding", lambda v: v.cast("double"))
    rows = embeddings.select("vec_id", c.alias("c")).where("size(c) > 0").where(F.forall("c", lambda v: F.coalesce(F.abs(v) < float(1 << 40), F.lit(False))))
    rows = written(rows.select("vec_id", F.transform("c", lambda v: F.floor(v * scale) + shift).alias("x")), "vectors")
    length = rows.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), "length").first()
    return rows.where(F.size("x") == (length["length"] if length else 0))


def _matrices(column: pa.ListArray, dimension: int) -> Iterator[np.ndarray]:
    """The vectors of a batch as matrices of bounded size."""
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
    step = max(1, CHUNK_BYTES // (8 * dimension))
    for lo in range(0, len(values), step):
        yield values[lo : lo + step]


def _met(rows: DataFrame, own: Callable[[np.ndarray], np.ndarray], size: int, dimension: int, kind: type) -> np.ndarray:
    """The sum over all vectors of ``own`` (of a matrix of vectors), ``size`` numbers."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, kind)
        for b in batches:
            for x in _matrices(b.column(0), dimension):
                total += own(x)
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, kind)
        for b in batches:
            for blob in b.column(0).to_pylist():
                total += np.frombuffer(blob, kind)
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["sums"])

    met = rows.select("x").mapInArrow(summed, "sums binary").repartition(MEET).mapInArrow(added, "sums binary").collect()  # MEET rows
    if kind is np.int64:  # whole numbers stay exact whatever their sum
        return np.array([sum(int(v) for v in column) for column in zip(*(np.frombuffer(r["sums"], kind) for r in met), strict=True)], object)
    return np.sum([np.frombuffer(r["sums"], kind) for r in met], axis=0)


def _orthogonal(new: np.ndarray, to: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``new`` adds to the orthonormal columns ``to``."""
    for _ in range(2):
        new = new - to @ (to.T @ new)
        size = np.linalg.norm(new, axis=0)
        new = new[:, size > 0] / size[size > 0]
        if not new.shape[1]:
            return new
        u, s, _ = np.linalg.svd(new, full_matrices=False)
        new = u[:, s > 1e-8 * s[0]]
    return new


def corrections(product: Callable[[np.ndarray], np.ndarray], ritz: np.ndarray, values: np.ndarray, residuals: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """MINRES for (I - QQ')(A - value I)(I - QQ') t = -residual, Q the Ritz vectors: all equations side by side, a product per step."""

    def projected(x: np.ndarray) -> np.ndarray:
        return x - ritz @ (ritz.T @ x)

    def over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.divide(a, b, out=np.zeros_like(a), where=b > 0)

    before = last = y = projected(-residuals)
    beta = start = np.linalg.norm(y, axis=0)
    one, none = np.ones_like(beta), np.zeros_like(beta)
    found, w, w_last = np.zeros_like(y), np.zeros_like(y), np.zeros_like(y)
    beta_last, turned, carried, rest, cos, sin = none, none, none, start, -one, none
    for step in range(steps):
        v = y * over(one, beta)
        y = projected(product(v) - v * values)
        if step:
            y = y - before * over(beta, beta_last)
        alpha = np.sum(v * y, axis=0)
        y = y - last * over(alpha, beta)
        before, last, beta_last, beta = last, y, beta, np.linalg.norm(y, axis=0)
        carried_last, delta, gamma_bar = carried, cos * turned + sin * alpha, sin * turned - cos * alpha
        carried, turned = sin * beta, -cos * beta
        gamma = np.hypot(gamma_bar, beta)
        cos, sin = over(gamma_bar, gamma), over(beta, gamma)
        rest, phi = sin * rest, cos * rest
        w_last, w = w, (v - w_last * carried_last - w * delta) * over(one, gamma)
        found = found + w * phi
        if (rest <= 1e-3 * start).all() or not beta.any():
            break
    return projected(found)


def eigenpairs(product: Callable[[np.ndarray], np.ndarray], dimension: int, wanted: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The largest ``wanted`` eigenvalues, falling, and their unit vectors, of the symmetric non-negative operator ``product``."""
    rng = np.random.default_rng(seed)
    wanted = min(wanted, dimension)
    space = np.linalg.qr(rng.standard_normal((dimension, min(dimension, wanted + SPARE))))[0]
    image = product(space)
    while True:
        small = space.T @ image
        value, turn = np.linalg.eigh((small + small.T) / 2)
        value, turn = value[::-1], turn[:, ::-1]
        ritz, theta = space @ turn[:, :wanted], value[:wanted]
        residual = image @ turn[:, :wanted] - ritz * theta
        open_ = np.linalg.norm(residual, axis=0) > EXACT * max(theta[0], 0)
        if not open_.any() or theta[0] <= 0:
            return theta, ritz / np.linalg.norm(ritz, axis=0)
        if space.shape[1] == dimension:  # the space is whole: a fresh product takes away what rounding has added up
            space = space @ turn
            space = np.linalg.qr(space)[0]
            small = space.T @ product(space)
            value, turn = np.linalg.eigh((small + small.T) / 2)
            return value[::-1][:wanted], (space @ turn[:, ::-1])[:, :wanted]
        if space.shape[1] > LARGEST * wanted:  # start anew from the best directions, with a fresh product
            space = np.linalg.qr(space @ turn[:, : wanted + SPARE])[0]
            image = product(space)
        new = _orthogonal(corrections(product, ritz, theta[open_], residual[:, open_]), space)
        if not new.shape[1]:
            new = _orthogonal(rng.standard_normal((dimension, min(SPARE, dimension - space.shape[1]))), space)
        space, image = np.hstack([space, new]), np.hstack([image, product(new)])


def fitted(rows: DataFrame, components: int = 16) -> Whitening | None:
    """The whitening of the distinct vectors ``x`` of ``rows``; None if there are none or all are equal."""
    fit = written(rows.select("x").distinct(), "distinct")
    first = fit.first()
    if first is None:
        return None
    dimension = len(first["x"])
    sums = _met(fit, lambda x: np.append(x.sum(axis=0), len(x)), dimension + 1, dimension, np.int64)
    n, total = int(sums[-1]), [int(s) for s in sums[:-1]]
    mean = Whitening(n, total, np.zeros((dimension, 0)), np.zeros(0), 0.0, 0.0)
    near, rest = mean.near(), mean.rest()

    def product(block: np.ndarray) -> np.ndarray:
        def own(x: np.ndarray) -> np.ndarray:
            y = (x - near) - rest
            return (y.T @ (y @ block)).ravel()

        return _met(fit, own, block.size, dimension, np.float64).reshape(block.shape) / n

    variances, directions = eigenpairs(product, dimension, min(components, dimension))
    held = variances > LEAST_SHARE * max(variances[0], 0)
    variances, directions = variances[held], directions[:, held]
    if not len(variances):
        return None
    k = len(variances)

    def measured(x: np.ndarray) -> np.ndarray:
        y = (x - near) - rest
        z = (y @ directions) / np.sqrt(variances)
        return np.concatenate([(z.T @ z).ravel(), z.sum(axis=0), [np.sum(y * y)]])

    sums = _met(fit, measured, k * k + k + 1, dimension, np.float64) / n
    covariance = sums[: k * k].reshape(k, k) - np.outer(sums[k * k : -1], sums[k * k : -1])
    return Whitening(n, total, directions, variances, float(sums[-1]), float(np.abs(covariance - np.eye(k)).max()))


def applied(rows: DataFrame, whitening: Whitening) -> DataFrame:
    """``vec_id``, ``component`` (from 1), ``deviation`` and ``whitened`` of each row and component of ``rows(vec_id, x)``."""
    near, rest, n = whitening.near(), whitening.rest(), whitening.n
    left = np.array([s - n * int(r) for s, r in zip(whitening.total, near, strict=True)], np.int64)
    k = len(whitening.variances)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = 0
            for x in _matrices(b.column(1), len(near)):
                z = (((x - near) - rest) @ whitening.directions) / np.sqrt(whitening.variances)
                far = np.sum(((x - near) * float(n) - left) ** 2, axis=1) >= 2.0**63
                part = n * np.where(far[:, None], 0, x - near) - left
                deviation = np.sum(np.where(far[:, None], 0, part) ** 2, axis=1)
                which = pa.array(np.repeat(np.arange(row, row + len(x)), k))
                component = np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))
                yield pa.record_batch([b.column(0).take(which), pa.array(component), pa.array(np.repeat(deviation, k), mask=np.repeat(far, k)), pa.array(z.ravel())], ["vec_id", "component", "deviation", "whitened"])
                row += len(x)

    return rows.select("vec_id", "x").mapInArrow(of, "vec_id long, component int, deviation long, whitened double")


def whitened(embeddings: DataFrame, components: int = 16, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """``applied`` with ``n``, ``explained`` (the component's share of all variance) and ``identity_error`` of ``embeddings(vec_id, embedding)``."""
    rows = whole(embeddings, scale, shift)
    found = fitted(rows, components)
    if found is None:
        none = "cast(null as {}) AS {}".format
        return rows.where("false").selectExpr("vec_id", none("int", "component"), none("long", "n"), none("long", "deviation"), none("double", "whitened"), none("double", "explained"), none("double", "identity_error"))
    share = F.element_at(F.array(*[F.lit(float(v / found.trace)) for v in found.variances]), F.col("component"))
    return applied(rows, found).select("vec_id", "component", F.lit(found.n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(found.identity_error).alias("identity_error"))
