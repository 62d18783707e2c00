"""PCA whitening of embeddings by LOBPCG over distributed covariance products.

Components become integers x = floor(SCALE c) + OFFSET. The covariance V of x is never formed: its product
with a block W of directions is the sum over rows of (x - m)((x - m) . W) / n with rows centred first, taken
over packed matrices of rows in Arrow batches, one dim x width matrix a partition, merged by treeReduce.

LOBPCG keeps a block X of `keep` wanted and GUARD further directions. Each round takes the residuals
R = VX - X diag(e) and the previous steps P, makes [R P] orthonormal to X and itself, sends it through one
distributed product, and solves the small symmetric problem on [X R P] (Rayleigh-Ritz). The rounds end when
every wanted residual |Vu - eu| is under TOLERANCE of the largest eigenvalue, or stops falling under LOOSE of
it; a last product of the final directions certifies them, and a residual over LOOSE fails the job.

Rows are whitened by the certified directions, and the covariance of the result is taken in a further pass:
its distance from the identity is a column.

Vectors that are null, empty, or hold null or non-finite entries take no part, nor do those of another
length than the commonest one (of equally common ones the longest), as they share no covariance with it.
Entries whose scaled value passes 2**53, and deviations past 64 bits, fail the job. A direction of no
variance (fewer rows or dimensions than components, equal vectors) gets null in `whitened`, and
identity_error is over the others; without any, `explained` is null and identity_error 0. Signs: the largest
entry of a component is positive. Equal eigenvalues: any orthonormal directions of their space. Rows that
repeat a vec_id, or have none, are rows of their own; extra columns are ignored; no rows in, none out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, floored, usable

SCALE, OFFSET = 1024.0, 100_000
KEEP, GUARD = 8, 8
PACK_BYTES = 4 << 20  # of one packed matrix
ROUNDS, TOLERANCE, LOOSE = 500, 1e-14, 1e-9


def _packed(dim: int):
    """Rows (id, x) of a partition as matrices of up to PACK_BYTES."""
    size = max(1, PACK_BYTES // (8 * dim))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            x = np.asarray(t.column("x").combine_chunks().flatten(), np.int64)
            return pa.RecordBatch.from_arrays([pa.array([t.num_rows]), pa.array([t.column("id").to_pylist()], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary())], ["n", "ids", "matrix"])

        for batch in batches:
            for i in range(0, batch.num_rows, size):
                part = batch.slice(i, size)
                held.append(part)
                n += part.num_rows
                if n >= size:
                    yield out()
                    held, n = [], 0
        if held:
            yield out()

    return pack


def _matrices(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for x in batch.column("matrix"):
            yield np.frombuffer(x.as_buffer(), np.int64).reshape(-1, dim)


def _summed(rows: DataFrame, partial, shape: tuple[int, ...], kind: type) -> np.ndarray:
    """The sum over partitions of partial(matrices), merged pairwise."""
    dim = shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, kind)
        for x in _matrices(batches, dim):
            total = total + partial(x)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sum"])

    parts = rows.select("matrix").mapInArrow(run, "sum binary").rdd.map(lambda r: np.frombuffer(r["sum"], kind))
    return parts.treeReduce(lambda a, b: a + b, 3).reshape(shape)


class Covariance:
    """Products with the covariance of packed rows."""

    def __init__(self, rows: DataFrame, n: int, total: np.ndarray):
        self.rows, self.n, self.mean, self.dim = rows, n, np.array([float(t) / n for t in total]), len(total)

    def product(self, block: np.ndarray) -> np.ndarray:
        """V block: one pass over the rows, whatever their number."""
        mean = self.mean

        def partial(x: np.ndarray) -> np.ndarray:
            c = x - mean
            return c.T @ (c @ block)

        return _summed(self.rows, partial, block.shape, np.float64) / self.n

    def trace(self) -> float:
        mean = self.mean
        return float(_summed(self.rows, lambda x: ((x - mean) ** 2).sum(axis=0), (self.dim,), np.float64).sum()) / self.n


def _orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of block's part outside against; directions that vanish are left out."""
    size = np.sqrt((block**2).sum(axis=0))
    block = block[:, size > 0] / size[size > 0]
    for _ in range(2):
        block = block - against @ (against.T @ block)
        if not block.shape[1]:
            break
        left, value, _ = np.linalg.svd(block, full_matrices=False)
        block = left[:, value > 1e-10 * max(value[0], 1e-300)] if value[0] > 1e-13 else block[:, :0]
    return block


def lobpcg(v: Covariance, keep: int, guard: int = GUARD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `keep` largest eigenvalues of v, their unit vectors and certified residuals."""
    width = min(keep + guard, v.dim)
    x = np.linalg.qr(np.random.default_rng(13).normal(size=(v.dim, width)))[0]
    vx = v.product(x)
    e, turn = np.linalg.eigh(x.T @ vx)
    e, x, vx = e[::-1], x @ turn[:, ::-1], vx @ turn[:, ::-1]
    p, least, stale = np.zeros((v.dim, 0)), np.inf, 0
    for _ in range(ROUNDS):
        residual = vx - x * e
        worst = np.sqrt((residual[:, :keep] ** 2).sum(axis=0)).max() / max(e[0], 1e-300)
        stale = 0 if worst < least / 2 else stale + 1
        least = min(least, worst)
        if e[0] <= 0 or worst <= TOLERANCE or (stale >= 4 and least <= LOOSE):
            break
        added = _orthonormal(np.concatenate([residual, p], axis=1), x)
        if not added.shape[1]:
            break
        basis, images = np.concatenate([x, added], axis=1), np.concatenate([vx, v.product(added)], axis=1)
        small = basis.T @ images
        e, turn = np.linalg.eigh((small + small.T) / 2)
        turn = turn[:, ::-1][:, :width]
        e = e[::-1][:width]
        p = added @ turn[width:]  # the step: what the new iterate has outside the old one
        x, vx = basis @ turn, images @ turn
    u = x[:, :keep] * np.where(np.abs(x).max(axis=0) == x.max(axis=0), 1.0, -1.0)[:keep]
    u = u / np.sqrt((u**2).sum(axis=0))
    image = v.product(u)  # certifies what is returned
    e = (u * image).sum(axis=0)
    residual = np.sqrt(((image - u * e) ** 2).sum(axis=0))
    if residual.max(initial=0.0) > LOOSE * max(e.max(initial=0.0), 1e-300) and e.max(initial=0.0) > 0:
        raise ArithmeticError(f"residuals {residual} of eigenvalues {e} after {ROUNDS} rounds")
    return e, u, residual


def whiten(vectors: DataFrame, keep: int = KEEP, scale: float = SCALE, offset: int = OFFSET) -> DataFrame:
    """vectors: id and v columns. vec_id, component, n, deviation, whitened, explained, identity_error,
    residual (certified, as a share of the largest eigenvalue) for every vector and component."""
    spark = vectors.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double"
    good = vectors.select("id", "v").where(usable(F.col("v")) & (F.size("v") > 0))
    sizes = good.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()  # one row a length
    if sizes is None:
        return spark.createDataFrame([], schema)
    dim, n = sizes["dim"], sizes["n"]
    x = F.transform("v", lambda c: floored(c, scale) + F.lit(offset))
    rows = cut(good.where(F.size("v") == dim).select("id", x.alias("x")).mapInArrow(_packed(dim), "n long, ids array<long>, matrix binary"))
    total = _summed(rows, lambda a: a.sum(axis=0), (dim,), np.int64)
    v = Covariance(rows, n, total)
    e, u, residual = lobpcg(v, min(keep, dim))
    trace = v.trace()
    alive = e > 1e-12 * max(trace, 0.0)
    mean, project = v.mean, u[:, alive] / np.sqrt(e[alive])
    kept = int(alive.sum())
    # the whitened rows' own mean (rounding only) and covariance
    middle = _summed(rows, lambda a: (a - mean).sum(axis=0), (dim,), np.float64) @ project / n

    def second(a: np.ndarray) -> np.ndarray:
        w = (a - mean) @ project - middle
        return np.concatenate([w.T @ w, np.zeros((dim - kept, kept))]) if kept <= dim else w.T @ w

    error = float(np.abs(_summed(rows, second, (dim, kept), np.float64)[:kept] / n - np.eye(kept)).max()) if kept else 0.0
    shared = spark.sparkContext.broadcast((total, mean, project, alive, e / trace if trace > 0 else None, residual / max(e[0], 1e-300)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, mean, project, alive, explained, certified = shared.value
        k = len(alive)
        for batch in batches:
            for ids, raw in zip(batch.column("ids"), batch.column("matrix"), strict=True):
                whole = np.frombuffer(raw.as_buffer(), np.int64).reshape(-1, dim)
                names = ids.values
                for i in range(0, len(whole), 4096):
                    a = whole[i : i + 4096]
                    out = np.zeros((len(a), k))
                    out[:, alive] = (a - mean) @ project
                    columns = [
                        pa.array(np.repeat(np.arange(i, i + len(a)), k)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(a))), pa.array(np.full(len(a) * k, n)), pa.array(np.repeat(_deviation(a, n, total), k)),
                        pa.array(out.ravel(), mask=np.tile(~alive, len(a))), pa.array(np.tile(explained, len(a))) if explained is not None else pa.nulls(len(a) * k, pa.float64()), pa.array(np.full(len(a) * k, error)), pa.array(np.tile(certified, len(a))),
                    ]
                    yield pa.RecordBatch.from_arrays([names.take(columns[0]), *columns[1:]], [x.split()[0] for x in schema.split(", ")])

    return rows.select("ids", "matrix").mapInArrow(run, schema)


def _deviation(a: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """Sum over dimensions of (n x - S)**2, exact; past 64 bits it fails."""
    largest = max((abs(int(a.max(initial=0))), abs(int(a.min(initial=0))))) * n + int(np.abs(total).max(initial=0))
    if largest < 1 << 62:
        d = a * n - total
        top = max(abs(int(d.max(initial=0))), abs(int(d.min(initial=0))))
        if top * top * a.shape[1] < 1 << 63:
            return (d * d).sum(axis=1)
    sums = [sum((int(x) * n - int(t)) ** 2 for x, t in zip(row, total, strict=True)) for row in a]
    if max(sums) >= 1 << 63:
        raise OverflowError("a deviation does not fit 64 bits")
    return np.array(sums, np.int64)
