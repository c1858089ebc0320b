"""Whitening of embeddings along the leading components of their covariance.

Sums and centred products are gathered where the vectors lie: every task hands over one row of sums
and one matrix, whatever the number of vectors. The small symmetric matrix is then sliced on the
driver: the signs in an LDLᵀ factorisation of the shifted matrix count its eigenvalues above the
shift, bisection by those counts isolates each leading one, Rayleigh quotient iteration finishes it,
and two more counts beside the result certify its number.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
_LONG = 2**63 - 1
#: Components with less than this part of the trace are rounding, not variance; they have no scale to divide by.
LEAST_SHARE = 1e-13
#: Rows of a block inside a task.
BLOCK = 4096


class Spectrum(NamedTuple):
    values: np.ndarray  #: eigenvalues, falling
    vectors: np.ndarray  #: one unit column each


# ---------------------------------------------------------------- symmetric eigenvalues by inertia
def inertia_above(matrix: np.ndarray, shift: float) -> int:
    """Number of eigenvalues above ``shift``: the positive pivots of LDLᵀ of matrix - shift·I.

    Pivots are chosen over the whole remaining block, 1x1 or 2x2 (Bunch and Parlett), so growth is
    bounded and an indefinite block is no obstacle. A 2x2 pivot is only taken where its determinant
    is negative, which gives one eigenvalue of each sign. By Sylvester's law the signs are those of
    the shifted matrix.
    """
    rest = matrix - shift * np.eye(len(matrix))
    bound, positive = (1 + math.sqrt(17)) / 8, 0
    while len(rest):
        diagonal = np.abs(np.diag(rest))
        best = int(diagonal.argmax())
        off = np.abs(rest)
        np.fill_diagonal(off, 0)
        row, column = divmod(int(off.argmax()), len(rest))
        largest = off[row, column]
        if max(largest, diagonal[best]) == 0:
            break
        if diagonal[best] >= bound * largest:
            keep = np.delete(np.arange(len(rest)), best)
            pivot, edge = rest[best, best], rest[keep, best]
            positive += bool(pivot > 0)
            rest = rest[np.ix_(keep, keep)] - np.outer(edge, edge) / pivot
        else:
            pair = [row, column]
            keep = np.delete(np.arange(len(rest)), pair)
            edge = rest[np.ix_(keep, pair)]
            positive += 1
            rest = rest[np.ix_(keep, keep)] - edge @ np.linalg.solve(rest[np.ix_(pair, pair)], edge.T)
    return positive


def _isolate(count: Callable[[float], int], low: float, high: float, wanted: int, width: float) -> list[tuple[float, float, int, int]]:
    """(low, high, first, last) from the top: each slice holds the eigenvalues first..last, one unless it is narrower than ``width``."""
    open_, done = [(low, high, count(low), 0)], []
    while open_:
        low, high, upto, above = open_.pop()
        if above >= wanted or upto == above:
            continue
        if upto - above == 1 or high - low <= width:
            done.append((low, high, above + 1, upto))
            continue
        middle = (low + high) / 2
        inside = count(middle)
        open_ += [(low, middle, upto, inside), (middle, high, inside, above)]
    return sorted(done, key=lambda part: part[2])


def _solve(matrix: np.ndarray, shift: float, right: np.ndarray, nudge: float) -> np.ndarray:
    """(matrix - shift·I)⁻¹ right; an exactly singular shift is moved by a rounding error."""
    unit = np.eye(len(matrix))
    while True:
        try:
            found = np.linalg.solve(matrix - shift * unit, right)
        except np.linalg.LinAlgError:
            found = None
        if found is not None and np.isfinite(found).all():
            return found
        shift, nudge = shift + nudge, 2 * nudge


def _without(block: np.ndarray, known: np.ndarray) -> np.ndarray:
    for _ in range(2):
        block = block - known @ (known.T @ block)
    return block


def _refine(matrix: np.ndarray, low: float, high: float, known: np.ndarray, norm: float) -> tuple[float, np.ndarray] | None:
    """Eigenvalue and vector inside (low, high] by Rayleigh quotient iteration; None if it leaves the slice."""
    eps = np.finfo(float).eps
    vector = np.random.default_rng(7).standard_normal((len(matrix), 1))
    value = (low + high) / 2
    for _ in range(3):
        vector = _without(_solve(matrix, value, vector, eps * norm), known)
        vector /= np.linalg.norm(vector)
    for _ in range(12):
        value = (vector.T @ matrix @ vector).item()
        if not low - 4 * eps * norm <= value <= high + 4 * eps * norm:
            return None
        if np.linalg.norm(matrix @ vector - value * vector) <= 8 * eps * norm:
            return value, vector
        vector = _without(_solve(matrix, value, vector, eps * norm), known)
        vector /= np.linalg.norm(vector)
    value = (vector.T @ matrix @ vector).item()
    return (value, vector) if np.linalg.norm(matrix @ vector - value * vector) <= 1e-10 * norm else None


def leading(matrix: np.ndarray, wanted: int) -> Spectrum:
    """The ``wanted`` largest eigenvalues, falling, with unit vectors, numbered by inertia counts.

    Eigenvalues closer than rounding can tell apart stay in one slice; their common space is found by
    inverse iteration on a block. Each sign is fixed by the largest entry, so reruns agree.
    """
    size = len(matrix)
    wanted = min(wanted, size)
    matrix = (matrix + matrix.T) / 2
    # Gershgorin: all eigenvalues lie within these bounds
    reach = np.abs(matrix).sum(axis=1) - np.abs(np.diag(matrix))
    low, high = float((np.diag(matrix) - reach).min()), float((np.diag(matrix) + reach).max())
    norm = max(abs(low), abs(high))
    if wanted == 0 or norm == 0:
        return Spectrum(np.zeros(wanted), np.eye(size)[:, :wanted])
    eps = np.finfo(float).eps
    margin, width = 16 * size * eps * norm, 64 * size * eps * norm
    counts: dict[float, int] = {}

    def count(shift: float) -> int:
        if shift not in counts:
            counts[shift] = inertia_above(matrix, shift)
        return counts[shift]

    values, vectors = [], np.zeros((size, 0))
    for bottom, top, first, last in _isolate(count, low - margin, high + margin, wanted, width):
        found = None
        while first == last and found is None and top - bottom > width:
            found = _refine(matrix, bottom, top, vectors, norm)
            if found is not None and not (count(found[0] + width) < first <= count(found[0] - width)):
                found = None  # converged to a neighbour
            if found is None:
                middle = (bottom + top) / 2
                bottom, top = (middle, top) if count(middle) >= first else (bottom, middle)
        if found is not None:
            values.append(found[0])
            vectors = np.hstack([vectors, found[1]])
            continue
        block = np.random.default_rng(7).standard_normal((size, last - first + 1))
        for _ in range(4):
            block = np.linalg.qr(_without(_solve(matrix, (bottom + top) / 2, block, eps * norm), vectors))[0]
        for column in block.T:  # equal within rounding: any basis of the space serves
            values.append(float(column @ matrix @ column))
            vectors = np.hstack([vectors, column[:, None]])
    values, vectors = np.array(values[:wanted]), vectors[:, :wanted]
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    return Spectrum(values, vectors * np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None], 0) < 0, -1.0, 1.0))


# ---------------------------------------------------------------- vectors in tasks
def _blocks(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of at most BLOCK rows with their vectors as a matrix of longs."""
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            flat = part.column(part.schema.get_field_index(name)).flatten()
            yield part, flat.to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


def longs(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """``embeddings`` with ``_x``: floor(64·c) + 1000000 of every entry; rows without such a vector are dropped.

    Dropped are null vectors, and those that are empty or hold a null, a non-finite entry or one
    whose number is no long. Vectors whose length is not the commonest (the longer at a tie) belong
    to no common covariance and go too.
    """
    entry = F.transform(F.col(vector), lambda c: c.cast("double"))
    sound = F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float(2**56))))
    fit = embeddings.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).withColumn("_sound", sound).where("_sound").drop("_sound")
    x = F.transform(entry, lambda c: F.floor(c * SCALE).cast("bigint") + SHIFT)
    sizes = fit.groupBy(F.size(vector).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    length = sizes[0]["size"] if sizes else 0
    return fit.where(F.size(vector) == length).withColumn("_x", x)


def _exact(values: np.ndarray, bound: int) -> np.ndarray:
    """The longs as Python integers where results up to ``bound`` would not fit."""
    return values.astype(object) if bound > _LONG else values


def totals(vectors: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and exact sums per dimension: one row of sums per task."""
    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for part, x in _blocks(batches, "_x"):
            own = _exact(x, int(np.abs(x).max()) * len(x)).sum(axis=0).astype(object)
            n, sums = n + len(x), own if sums is None else sums + own
        if sums is not None:
            size = len(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), pa.array([str(s) for s in sums])], ["k", "n", "s"])

    rows = vectors.select("_x").mapInArrow(per_task, "k int, n bigint, s string").groupBy("k").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("k").collect()
    return (rows[0]["n"], [int(row["s"]) for row in rows]) if rows else (0, [])


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n·x - S, exactly, and the same over n as doubles."""
    spread = max(abs(int(x.max())), abs(int(x.min()))) * n + max(map(abs, sums.tolist()))
    wide = _exact(x, spread) * n - (sums if spread > _LONG else sums.astype(np.int64))
    return wide, wide.astype(float) / n


def _gram(rows: DataFrame, make: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum over all rows of the outer product of ``make``'s row with itself; a task hands over one matrix."""
    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _blocks(batches, "_x"):
            made = make(x)
            total = made.T @ made if total is None else total + made.T @ made
        if total is not None:
            i, j = np.triu_indices(size)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j], pa.float64())], ["i", "j", "v"])

    cells = rows.select("_x").mapInArrow(per_task, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    matrix = np.zeros((size, size))
    for cell in cells:
        matrix[cell["i"], cell["j"]] = matrix[cell["j"], cell["i"]] = cell["v"]
    return matrix


def _column_sums(rows: DataFrame, make: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _blocks(batches, "_x"):
            own = make(x).sum(axis=0)
            total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total, pa.float64())], ["k", "v"])

    sums = np.zeros(size)
    for cell in rows.select("_x").mapInArrow(per_task, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        sums[cell["k"]] = cell["v"]
    return sums


class Whitening(NamedTuple):
    n: int
    sums: list[int]
    explained: np.ndarray
    projection: np.ndarray  #: dimensions x components, each column over the root of its eigenvalue
    identity_error: float


def fit_whitening(vectors: DataFrame, *, components: int = COMPONENTS) -> Whitening:
    """Components of the covariance of all rows of :func:`longs`, and how far their whitened covariance is from the identity.

    Passes: sums, centred products, and sums and centred products of the whitened rows. What reaches
    the driver has the size of the matrix. Components without variance are left out.
    """
    n, sums = totals(vectors)
    size, exact = len(sums), np.array(sums, dtype=object)
    if not n:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    covariance = _gram(vectors, lambda x: _centred(x, n, exact)[1], size) / n
    spectrum, trace = leading(covariance, components), float(np.trace(covariance))
    kept = spectrum.values > LEAST_SHARE * trace if trace > 0 else np.zeros(len(spectrum.values), bool)
    values, basis = spectrum.values[kept], spectrum.vectors[:, kept]
    projection = basis / np.sqrt(values) if len(values) else basis
    count = len(values)
    if not count:
        return Whitening(n, sums, np.zeros(0), projection, 0.0)
    means = _column_sums(vectors, lambda x: _centred(x, n, exact)[1] @ projection, count) / n
    after = _gram(vectors, lambda x: _centred(x, n, exact)[1] @ projection - means, count) / n
    return Whitening(n, sums, values / trace, projection, float(np.abs(after - np.eye(count)).max()))


def whiten(embeddings: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per vector and component.

    Rows are dropped as :func:`longs` says; null and repeated ids stay, repeated rows count as often
    as they occur. Components without variance (constant or dependent dimensions, a single vector)
    have no rows, an empty table has none at all. ``deviation`` is exact, and null where it does not
    fit a long. Of equal eigenvalues any basis of their space is taken, the same for all rows. Other
    columns neither matter nor clash.
    """
    vectors = longs(embeddings.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("embedding")))
    fitted = fit_whitening(vectors, components=components)
    shared = embeddings.sparkSession.sparkContext.broadcast(fitted)  # dimensions x components numbers

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        count, exact = model.projection.shape[1], np.array(model.sums, dtype=object)
        for part, x in _blocks(batches, "_x"):
            if not count:
                continue
            wide, centred = _centred(x, model.n, exact)
            widest = int(abs(wide).max())
            squares = (_exact(wide, widest * widest * wide.shape[1]) ** 2).sum(axis=1)
            ids = part.column(part.schema.get_field_index("vec_id"))
            rows = np.repeat(np.arange(len(x)), count)
            yield pa.RecordBatch.from_arrays([
                ids.take(pa.array(rows)), pa.array(np.tile(np.arange(1, count + 1), len(x)), pa.int32()),
                pa.array([int(s) if s <= _LONG else None for s in squares.tolist()], pa.int64()).take(pa.array(rows)),
                pa.array((centred @ model.projection).ravel(), pa.float64()), pa.array(np.tile(model.explained, len(x)), pa.float64()),
            ], ["vec_id", "component", "deviation", "whitened", "explained"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, deviation bigint, whitened double, explained double"
    return vectors.select("vec_id", "_x").mapInArrow(per_task, schema).select(
        "vec_id", "component", F.lit(fitted.n).cast("bigint").alias("n"), "deviation", "whitened", "explained",
        F.lit(fitted.identity_error).alias("identity_error"),
    )
