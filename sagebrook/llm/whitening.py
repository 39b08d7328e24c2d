"""Whitened embeddings by block Golub-Kahan-Lanczos bidiagonalisation.

X is the table of distinct centred vectors, a row each. A step multiplies a block
of right vectors by X and the product by Xᵀ, both within one pass of the tasks
over the rows. The left vectors are as long as the table, so they aren't kept:
each is X times a short vector of coefficients, and inner products with them are
inner products of their coefficients with what Xᵀ brings back. Both sides are
reorthogonalised in full, twice. The driver holds matrices of the vectors' width
only; the singular value decomposition of the small block-bidiagonal matrix gives
components and deviations, and a last pass measures their residual.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

SCALE = 256
SEED = 20240611
#: A direction with less than this share of the largest variance counts as having none.
NOTHING = 1e-12
#: Largest residual of a component, as a share of the largest variance; a run that misses it goes on from where it came to.
RESIDUAL = 1e-12
RUNS = 3
#: Rows that a task turns to matrices at a time hold so many entries.
ENTRIES = 1 << 20
_EXACT = 1 << 62


@dataclass
class Whitening:
    """What was fitted: ``n`` distinct vectors, their sums by dimension, components (columns), variances, the trace and the identity error."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float
    residual: float
    identity_error: float
    passes: int


def _parts(batch: pa.RecordBatch, width: int) -> Iterator[pa.RecordBatch]:
    rows = max(1, ENTRIES // max(1, width))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def whole_vectors(rows: DataFrame, vector_col: str) -> DataFrame:
    """All columns as ``row`` and ``x``, the floored vector as little-endian longs, for the rows whose vector has finite entries only.

    Entries beyond a long count as the nearest long.
    """
    given = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).where("v IS NOT NULL")
    schema = given.select("row", F.lit(b"").alias("x")).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, 64):
                v = part.column(1)
                sizes = pc.list_value_length(v).to_numpy()
                flat = v.flatten()
                c = flat.to_numpy(zero_copy_only=False).astype(float)  # null entries become NaN
                ends = np.cumsum(sizes)
                bad = np.concatenate([[0], np.cumsum(~np.isfinite(c))])
                good = bad[ends] == bad[ends - sizes]
                with np.errstate(all="ignore"):
                    y = np.floor(SCALE * c) + 0.0
                    x = np.where(y >= 2.0**63, 2**63 - 1, np.where(y < -(2.0**63), -(2**63), 0)).astype(np.int64)
                    inside = np.abs(y) < 2.0**63
                x[inside] = y[inside].astype(np.int64)
                data = x.astype("<i8").tobytes()
                keep = np.flatnonzero(good)
                made = [data[8 * a : 8 * b] for a, b in zip((ends - sizes)[keep].tolist(), ends[keep].tolist())]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep)), pa.array(made, pa.binary())], ["row", "x"])

    return given.mapInArrow(work, schema)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, width)


def _summed(fit: DataFrame, width: int, of: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all rows of ``of`` (a block of vectors): summed in the tasks, then entry by entry in a shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for part in _parts(batch, width):
                if part.num_rows:
                    total += of(_matrix(part.column(0), width))
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int64()), pa.array(total.ravel())], ["place", "value"])

    out = np.zeros(math.prod(shape))
    for r in fit.select("x").mapInArrow(work, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect():  # an entry each
        out[r["place"]] = r["value"]
    return out.reshape(shape)


def _exact_sums(fit: DataFrame, width: int) -> tuple[int, list[int], int]:
    """Number of vectors, sums by dimension and sum of all squares, as whole numbers of any size."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (width + 2)
        for batch in batches:
            for part in _parts(batch, width):
                if not part.num_rows:
                    continue
                x = _matrix(part.column(0), width)
                total[0] += len(x)
                if float(np.abs(x.astype(float)).max(initial=0)) ** 2 * x.size < _EXACT:
                    sums, squares = x.sum(0).tolist(), int((x * x).sum())
                else:
                    x = x.astype(object)
                    sums, squares = x.sum(0).tolist(), int((x * x).sum())
                total[1 : width + 1] = [a + b for a, b in zip(total[1:], sums)]
                total[width + 1] += squares
        # Digits in base 2^40 keep the sums of the tasks within a long.
        rows = [(p, d, (abs(t) >> 40 * d & (1 << 40) - 1) * (1 if t >= 0 else -1)) for p, t in enumerate(total) for d in range(max(1, (abs(t).bit_length() + 39) // 40))]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["place", "digit", "value"])

    total = [0] * (width + 2)
    for r in fit.select("x").mapInArrow(work, "place long, digit long, value long").groupBy("place", "digit").agg(F.sum("value").alias("value")).collect():  # a few digits of width + 2 numbers
        total[r["place"]] += r["value"] << 40 * r["digit"] if r["value"] >= 0 else -(-r["value"] << 40 * r["digit"])
    return total[0], total[1 : width + 1], total[width + 1]


def _against(basis: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The block without its parts along an orthonormal basis, taken out twice."""
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    return block


def _orthonormal(block: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(Q, R) with block = Q R; directions below ``least`` are left out."""
    u, s, vt = np.linalg.svd(block, full_matrices=False)
    keep = s > least
    return u[:, keep], s[keep, None] * vt[keep]


def bidiagonalised(product: Callable[[np.ndarray], np.ndarray], start: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """(V, B): right vectors and the block-bidiagonal matrix with XV = UB, from ``product`` (G -> Xᵀ(XG)) and a start block.

    Runs until ``steps`` right vectors stand, at most the width. Where a block is exhausted the next begins with random vectors
    against all before, so that repeated singular values are found as often as they are there.
    """
    width, size = start.shape
    random = np.random.default_rng(SEED + 1)
    v = np.zeros((width, 0))  # right vectors
    c = np.zeros((width, 0))  # U = X c
    p = np.zeros((width, 0))  # Xᵀ U
    rows: list[tuple[int, int, np.ndarray]] = []  # blocks of B: first row, first column
    block, _ = _orthonormal(start, 0.0)
    above, before = None, 0  # B of the step before, and where its left vectors begin
    largest = 0.0
    while block.shape[1]:
        g = block if above is None else block - c[:, before:] @ above.T
        z = product(g)
        for _ in range(2):  # reorthogonalised against all left vectors
            h = c.T @ z
            g, z = g - c @ h, z - p @ h
        m = g.T @ z
        e, q = np.linalg.eigh((m + m.T) / 2)
        largest = max(largest, float(e.max(initial=0)))
        keep = e > 1e-14 * largest  # what a Gram matrix can tell from nothing
        root = np.sqrt(e[keep])
        a = root[:, None] * q[:, keep].T
        rows.append((c.shape[1], v.shape[1], a))
        if above is not None:
            rows.append((before, v.shape[1], above.T))
        before = c.shape[1]
        v = np.hstack([v, block])
        if v.shape[1] >= min(steps, width):
            c = np.hstack([c, np.zeros((width, len(root)))])
            break
        new_c, new_p = g @ q[:, keep] / root, z @ q[:, keep] / root
        c, p = np.hstack([c, new_c]), np.hstack([p, new_p])
        f = _against(v, new_p - block @ a.T)
        block, above = _orthonormal(f, 1e-10 * math.sqrt(largest))
        block = _orthonormal(_against(v, block), 0.5)[0] if block.shape[1] else block
        above = block.T @ f
        if not block.shape[1]:
            fresh = _against(v, random.standard_normal((width, min(size, width - v.shape[1]))))
            block, above = _orthonormal(_against(v, _orthonormal(fresh, 0.0)[0]), 0.5)[0], None
        if block.shape[1] > width - v.shape[1]:
            block = block[:, : width - v.shape[1]]
            above = None if above is None else above[: width - v.shape[1]]
    b = np.zeros((c.shape[1], v.shape[1]))
    for i, j, part in rows:
        b[i : i + part.shape[0], j : j + part.shape[1]] = part
    return v, b


def fit_whitening(fit: DataFrame, width: int, components: int = 4, block: int | None = None, steps: int | None = None) -> Whitening | None:
    """Components of the distinct vectors in ``fit`` (column x); None without vectors.

    ``block`` right vectors go with each pass: an eighth of the width unless given, at least 8, so a full run takes about eight
    passes over the data at any width; ``steps`` ends it early. A run is repeated from its components if their residual is above ``RESIDUAL``.
    """
    n, sums, squares = _exact_sums(fit, width)
    if not n:
        return None
    trace = (n * squares - sum(s * s for s in sums)) / (n * n)  # whole numbers, divided once
    whole, rest = np.array([s // n for s in sums], float), np.array([(s % n) / n for s in sums])
    centred = lambda x: (x - whole) - rest
    count = [2]

    def product(g: np.ndarray) -> np.ndarray:
        count[0] += 1

        def both(x: np.ndarray) -> np.ndarray:
            y = centred(x)
            return y.T @ (y @ g)

        return _summed(fit, width, both, g.shape)

    block = block or max(8, -(-width // 8))
    start = np.random.default_rng(SEED).standard_normal((width, min(block, width)))
    for _ in range(RUNS):
        v, b = bidiagonalised(product, start, steps or width)
        _, s, qt = np.linalg.svd(b, full_matrices=False)
        top = v @ qt[:components].T
        top = np.linalg.qr(top)[0] if top.shape[1] else top
        z = product(top)
        e, q = np.linalg.eigh((top.T @ z + z.T @ top) / 2 / n)
        order = np.argsort(-e)
        e, top, z = e[order], top @ q[:, order], z @ q[:, order] / n
        residual = float(np.abs(z - top * e).max(initial=0) / max(e.max(initial=0), 1e-300))
        if residual <= RESIDUAL or not trace:
            break
        start = np.hstack([top, start])[:, : max(start.shape[1], top.shape[1])]
    keep = e > NOTHING * max(trace, 1e-300)
    e, top = e[keep], top[:, keep]

    def gram(x: np.ndarray) -> np.ndarray:
        w = centred(x) @ top / np.sqrt(e)
        return np.vstack([w.T @ w, w.sum(0)])

    k = len(e)
    total = _summed(fit, width, gram, (k + 1, k)) / n
    error = float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max(initial=0))
    return Whitening(n, sums, top, e, trace, residual, error, count[0])


def whitened_embeddings(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4, block: int | None = None) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component.

    Rows whose vector is null or has null or non-finite entries go. Vectors repeat (a third may be one vector): copies combine
    in the tasks before the distinct ones move, and each gets its rows at the end. Of vectors of unequal lengths those of
    the most frequent length stay, of the longer one on a tie; vectors without entries go. Null ids and repeated rows keep their
    rows, other columns don't matter. Components without variance have no rows, so equal vectors alone and an empty table give none.
    ``deviation`` is null where it doesn't fit a long. The fit runs when this is called; the distinct vectors are stored.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    out = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    x = whole_vectors(vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").alias("v")), "v")
    distinct = stored(x.groupBy("x").agg(F.count(F.lit(1)).alias("copies")), "distinct-vectors")
    by_width = distinct.where("length(x) > 0").groupBy((F.length("x") / 8).cast("int").alias("width")).agg(F.sum("copies").alias("n"))
    first = by_width.orderBy(F.desc("n"), F.desc("width")).head()
    fitted = first and fit_whitening(distinct.where(F.length("x") == 8 * first["width"]), first["width"], components, block)
    if not fitted or not len(fitted.variances):
        return vectors.sparkSession.createDataFrame([], out)
    width, n, sums = first["width"], fitted.n, fitted.sums
    bound = max(map(abs, sums))
    whole, rest = np.array([s // n for s in sums], float), np.array([(s % n) / n for s in sums])
    project, k = fitted.components / np.sqrt(fitted.variances), len(fitted.variances)
    explained = (fitted.variances / fitted.trace).tolist()
    error = fitted.identity_error

    def exact(m: np.ndarray) -> list[int | None]:
        most = float(np.abs(m.astype(float)).max(initial=0)) * n + bound
        if most * most * width < _EXACT:
            d = m * n - np.array(sums, np.int64)
            return (d * d).sum(1).tolist()
        d = m.astype(object) * n - np.array(sums, object)
        return [v if v < 1 << 63 else None for v in (d * d).sum(1).tolist()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, width):
                rows = part.num_rows
                if not rows:
                    continue
                m = _matrix(part.column(1), width)
                w = ((m - whole) - rest) @ project
                twice = pa.array(np.repeat(np.arange(rows), k))
                columns = [
                    part.column(0).take(twice), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, n, np.int64)),
                    pa.array(exact(m), pa.int64()).take(twice), pa.array(w.ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.where(F.length("x") == 8 * width).select("row.vec_id", "x").mapInArrow(work, out)
