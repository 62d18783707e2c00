"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped into buckets by length (Euclidean norm). For a query q whose k-th best product
so far is t, a bucket of longest length L is skipped when |q| L < t; otherwise the local threshold
t / (|q| L) is the least cosine a member needs to matter. In a bucket where that cosine is low only
its length prunes (a prefix by falling length); where it is high, the query's heaviest coordinates
F bound the product by q_F.p_F + |q_rest| |p_rest| first. Survivors' products are verified.

A query block first meets the longest buckets, up to SEEDS of them and SEED_BYTES, one after the
other, each tightening its thresholds for the next. The rest is a grid: blocks of like length make rows of about
CELL_BYTES, buckets of like length columns, and a cell is one task's work. Every vector is sent once for each
row, every query once for each column of cells that the thresholds leave (a cell's longest product against
the least threshold in it), so the shuffle grows with rows x columns of large tiles, not with
blocks x buckets. Inside a cell a block meets the buckets by falling length, its thresholds tightening from each to
the next. Blocks and buckets are packed matrices, so no row pairs are ever formed; a cell gives at most k
rows a query, and a window keeps k a query, limited in each task before the shuffle.

Products are exact: components are quantised to integers, multiplied in float64 while below 2**53
(else in Python integers; a scaled component past 2**53 or a score past 64 bits fails the job). Vectors that are null or hold null or non-finite components, and rows of
null id, take no part. A vector is compared only with vectors of as many components. Ties go to the
smaller id. Rows that repeat an id are separate candidates and separate queries, each of which leaves
out itself alone; their answers stand under one query_id with ranks of their own. An empty vector
scores 0 with other empty ones. An empty table gives no rows; fewer than k candidates give all of
them. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut, floored, usable

BUCKET, BLOCK = 4096, 512
SEEDS, SEED_BYTES = 4, 32 << 20
CELL_BYTES = 48 << 20  # of one side of a cell
BROADCAST_PARTS = 1 << 20  # parts whose places in the grid are broadcast
_LOW_COSINE = 0.3  # under it, coordinates prune too little to pay
_FOCUS = 16
_PACKED = "dim int, n long, longest double, ids binary, rows binary, matrix binary"
_FOUND = "query_id long, query_row long, vec_id long, vec_row long, score long"


def quantised(column: Column, scale: float) -> Column:
    """floor(scale * x) of each component, or null where the vector takes no part."""
    return F.when(usable(column), F.transform(column, lambda x: floored(x, scale)))


def _packed(size: int):
    """A partition's rows (id, row, dim, v, norm) become matrices of one dimension, of up to size rows
    by falling norm."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).sort_by([("dim", "ascending"), ("norm", "descending"), ("id", "ascending"), ("row", "ascending")])
            dims = np.asarray(t.column("dim"))
            edges = [0, *(np.flatnonzero(dims[1:] != dims[:-1]) + 1), len(dims)]
            for a, b in zip(edges, edges[1:], strict=False):
                for i in range(a, b, size):
                    part = t.slice(i, min(size, b - i)).combine_chunks()
                    raw = lambda c: pa.array([np.asarray(part.column(c), np.int64).tobytes()], pa.binary())  # noqa: B023, E731
                    matrix = np.asarray(part.column("v").combine_chunks().flatten(), np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([dims[i]], pa.int32()), pa.array([part.num_rows]), pa.array([np.asarray(part.column("norm")).max()]), raw("id"), raw("row"), pa.array([matrix.tobytes()], pa.binary())],
                        ["dim", "n", "longest", "ids", "rows", "matrix"],
                    )

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 16 * size:
                yield from out()
                held, rows = [], 0
        if rows:
            yield from out()

    return pack


class Side:
    """Vectors of one block or bucket: ids, row numbers, components."""

    def __init__(self, r: dict, prefix: str = ""):
        self.ids, self.rows = (np.frombuffer(r[prefix + x], np.int64) for x in ("ids", "rows"))
        self.v = np.frombuffer(r[prefix + "matrix"], np.int64).reshape(len(self.ids), r["dim"])
        self.f = self.v.astype(np.float64)
        self.norm = np.sqrt((self.f**2).sum(axis=1))


Hits = tuple[np.ndarray, np.ndarray, np.ndarray]  # ids, row numbers, scores of a query's best


def best(q: Side, p: Side, least: np.ndarray, k: int) -> dict[int, Hits]:
    """By query: the k best of one bucket with a score >= least."""
    big = float(np.abs(q.v).max(initial=0)) * float(np.abs(p.v).max(initial=0)) * max(q.v.shape[1], 1) >= 2.0**53
    out: dict[int, Hits] = {}
    longest = p.norm.max(initial=0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(q.norm * longest > 0, least / (q.norm * longest), np.where(least <= 0, -np.inf, np.inf))
        reach = np.where(least > 0, least / q.norm, -1.0)
    prefix = np.searchsorted(-p.norm, -(reach * (1 - 1e-12)), "right")  # members long enough, by falling length
    possible = (cosine <= 1 + 1e-9) & (prefix > 0)
    for i in np.flatnonzero(possible & (cosine >= _LOW_COSINE)):
        focus = np.argpartition(-np.abs(q.f[i]), min(_FOCUS, q.f.shape[1] - 1))[:_FOCUS]
        part = p.f[: prefix[i], focus]
        rest = np.sqrt(max(q.norm[i] ** 2 - (q.f[i, focus] ** 2).sum(), 0.0))
        bound = part @ q.f[i, focus] + rest * np.sqrt(np.maximum(p.norm[: prefix[i]] ** 2 - (part**2).sum(axis=1), 0.0))
        kept = np.flatnonzero(bound >= least[i] - 1e-6 * max(1.0, abs(least[i])))
        out[i] = _cut(q.rows[i], p, kept, _products(q, p, np.array([i]), kept, big)[0], least[i], k)
    low = np.flatnonzero(possible & (cosine < _LOW_COSINE))
    if len(low):
        kept = np.arange(int(prefix[low].max()))
        for i, score in zip(low, _products(q, p, low, kept, big), strict=True):
            out[i] = _cut(q.rows[i], p, kept, score, least[i], k)
    return out


def _products(q: Side, p: Side, i: np.ndarray, j: np.ndarray, big: bool) -> np.ndarray:
    if big:
        return np.array([[sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for y in p.v[j]] for x in q.v[i]], np.int64).reshape(len(i), len(j))
    return (q.f[i] @ p.f[j].T).astype(np.int64)


def _cut(own: int, p: Side, j: np.ndarray, score: np.ndarray, least: float, k: int) -> Hits:
    """The k best of members j by score and then id, of those >= least and not the query itself."""
    kept = np.flatnonzero((score >= least) & (p.rows[j] != own))
    if len(kept) > k:
        edge = np.partition(score[kept], len(kept) - k)[len(kept) - k]
        kept = kept[score[kept] >= edge]
    return _first((p.ids[j[kept]], p.rows[j[kept]], score[kept]), k)


def _first(hits: Hits, k: int) -> Hits:
    order = np.lexsort((hits[1], hits[0], -hits[2]))[:k]
    return tuple(x[order] for x in hits)


def _rows(q: Side, found: dict[int, Hits]) -> pa.RecordBatch:
    parts = [(np.full(len(h[0]), q.ids[i]), np.full(len(h[0]), q.rows[i]), *h) for i, h in found.items()]
    columns = [np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 5
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["query_id", "query_row", "vec_id", "vec_row", "score"])


def _tightened(q: Side, p: Side, floor: np.ndarray, found: dict[int, Hits], k: int) -> None:
    """Add one bucket's best to what was found, and raise the thresholds to each query's k-th best."""
    for i, hits in best(q, p, floor, k).items():
        found[i] = _first(tuple(np.concatenate(x) for x in zip(found[i], hits, strict=True)), k) if i in found else hits
        if len(found[i][0]) >= k:
            floor[i] = max(floor[i], found[i][2][k - 1])


def _rows_schema() -> pa.Schema:
    return pa.schema([(x, pa.int64()) for x in ("query_id", "query_row", "vec_id", "vec_row", "score")])


def _grid(packed: DataFrame, key: str, longest: Column, lowest: Column, most: int) -> DataFrame | None:
    """dim, part, tile, longest, lowest: neighbouring parts (partitions of packed) make tiles of about `most` bytes;
    longest and lowest are their tile's. One row a part is read by the driver; None if there are no parts."""
    parts = packed.groupBy("dim", F.shiftright(key, 33).alias("part")).agg(F.sum("n").alias("n"), longest.alias("longest"), lowest.alias("lowest")).collect()
    tiles, at, room, of = [], -1, 0, None
    for r in sorted(parts, key=lambda r: (r["dim"], r["part"])):
        size = r["n"] * 8 * (r["dim"] + 2)
        if r["dim"] != of or size > room:
            at, room, of = at + 1, most + most // 4, r["dim"]
        room -= size
        tiles.append((r["dim"], r["part"], at, r["longest"], r["lowest"]))
    if not tiles:
        return None
    top, low = {}, {}
    for _, _, t, a, b in tiles:
        top[t], low[t] = max(top.get(t, a), a), min(low.get(t, b), b)
    rows = [(dim, part, t, top[t], low[t]) for dim, part, t, _, _ in tiles]
    return packed.sparkSession.createDataFrame(rows, "dim int, part long, tile int, longest double, lowest double")


def top_k(vectors: DataFrame, queries: Column, k: int = 20, scale: float = 64.0) -> DataFrame:
    """vectors: id and v columns; queries: the rows that ask. Returns query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows = vectors.select("id", quantised(F.col("v"), scale).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).where("v is not null and id is not null")
    rows = cut(rows.select("*", F.size("v").alias("dim"), norm.alias("norm"), F.monotonically_increasing_id().alias("row")))
    sizes = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # one row a dimension
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    members = rows.select("id", "row", "dim", "v", "norm")
    bytes_ = sum(n * 8 * (dim + 2) for dim, n in sizes.items())
    # equal-count parts by falling length; the id makes a range key with few ties. Small tables make smaller
    # columns, so that there are cells for all cores
    tile = min(CELL_BYTES, max(1 << 20, bytes_ // (2 * spark.sparkContext.defaultParallelism)))
    parts = max(1, -(-bytes_ // tile))
    buckets = cut(members.repartitionByRange(parts, "dim", F.desc("norm"), "id").mapInArrow(_packed(BUCKET), _PACKED).withColumn("bucket", F.monotonically_increasing_id()))
    asking = rows.where("asks").select("id", "row", "dim", "v", "norm")
    asked = asking.agg(F.sum(8 * (F.col("dim") + 2))).first()[0]
    if not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    packed = asking.repartitionByRange(max(1, -(-asked // CELL_BYTES)), "dim", F.desc("norm"), "id").mapInArrow(_packed(BLOCK), _PACKED)
    blocks = packed.select("dim", "n", F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"), F.col("matrix").alias("q_matrix"), F.col("longest").alias("q_longest"))
    # at most SEEDS rows a dimension
    nth = F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("longest"), "bucket"))
    ahead = buckets.select("dim", "longest", "bucket", nth.alias("nth")).where(F.col("nth") <= SEEDS).collect()
    seeds, room = [], SEED_BYTES
    for r in sorted(ahead, key=lambda r: (-sizes[r["dim"]], r["dim"], r["nth"])):
        if room >= BUCKET * (r["dim"] + 2) * 8 or not seeds:
            seeds.append(r["bucket"])
            room -= BUCKET * (r["dim"] + 2) * 8

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks with their thresholds, the least of them, and the best of the seeds as an Arrow file."""
        for batch in batches:
            least, answers = [], []
            for r in batch.to_pylist():
                q = Side(r, "q_")
                floor, found = np.full(len(q.ids), -np.inf), {}
                for p in sorted(r["seeds"] or (), key=lambda x: -x["longest"]):
                    _tightened(q, Side(p | {"dim": r["dim"]}), floor, found, k)
                least.append(floor)
                answer = _rows(q, found)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, answer.schema) as writer:
                    writer.write_batch(answer)
                answers.append(sink.getvalue().to_pybytes())
            keep = ["dim", "n", "q_ids", "q_rows", "q_matrix", "q_longest"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x) for x in keep), pa.array([x.tobytes() for x in least], pa.binary()), pa.array([float(x.min(initial=np.inf)) for x in least], pa.float64()), pa.array(answers, pa.binary())],
                [*keep, "least", "lowest", "answers"])

    # a few matrices of at most SEED_BYTES in all: their size is bounded, so they may be broadcast
    first = buckets.where(F.col("bucket").isin(seeds)).groupBy("dim").agg(F.collect_list(F.struct("longest", "ids", "rows", "matrix")).alias("seeds"))
    kept = "dim int, n long, q_ids binary, q_rows binary, q_matrix binary, q_longest double"
    blocks = blocks.join(F.broadcast(first), "dim", "left").select("dim", "n", "q_ids", "q_rows", "q_matrix", "q_longest", "seeds").mapInArrow(seeded, f"{kept}, least binary, lowest double, answers binary")
    blocks = cut(blocks.withColumn("block", F.monotonically_increasing_id()))
    found = blocks.select("answers").mapInArrow(_unpacked, _FOUND)
    rest = buckets.where(~F.col("bucket").isin(seeds))
    lines, columns = _grid(blocks, "block", F.max("q_longest"), F.min("lowest"), CELL_BYTES), _grid(rest, "bucket", F.max("longest"), F.lit(0.0), tile)
    if columns is not None:
        at = lambda df, name: df.select("dim", "tile", F.col("longest").alias(f"{name}_longest"), "lowest").distinct()
        reached = F.col("r_longest") * F.col("c_longest") >= F.col("r.lowest") * (1 - 1e-12)
        cells = at(lines, "r").alias("r").join(at(columns, "c").alias("c"), "dim").where(reached).select("dim", F.col("r.tile").alias("line"), F.col("c.tile").alias("column"))
        placed = lambda df, key, grid, name: df.join(F.broadcast(grid) if grid.count() <= BROADCAST_PARTS else grid, (df["dim"] == grid["of"]) & (F.shiftright(key, 33) == grid["part"])).select(df["*"], F.col("tile").alias(name))
        cells = cut(cells)  # a row a cell
        asks = placed(blocks.drop("answers", "lowest"), "block", lines.withColumnRenamed("dim", "of"), "line").join(cells, ["dim", "line"])
        holds = placed(rest, "bucket", columns.withColumnRenamed("dim", "of"), "column").join(cells, ["dim", "column"])

        def answered(left: pa.Table, right: pa.Table) -> pa.Table:
            """A cell: each block meets the buckets by falling length."""
            members = [Side(r) for r in sorted(right.to_pylist(), key=lambda r: (-r["longest"], r["bucket"]))]
            out = []
            for r in left.to_pylist():
                q, floor, hits = Side(r, "q_"), np.frombuffer(r["least"]).copy(), {}
                for p in members:
                    _tightened(q, p, floor, hits, k)
                out.append(_rows(q, hits))
            return pa.Table.from_batches(out, _rows_schema())

        # both sides grow with the table: tiles are dealt by cell, never broadcast
        by_cell = lambda df, *names: df.select("dim", "line", "column", *names).groupBy("dim", "line", "column")
        met = by_cell(asks, "q_ids", "q_rows", "q_matrix", "least").cogroup(by_cell(holds, "bucket", "longest", "ids", "rows", "matrix")).applyInArrow(answered, _FOUND)
        found = found.unionByName(met)
    by = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "vec_row")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.column("answers"):
            with pa.ipc.open_stream(x.as_buffer()) as reader:
                yield from reader
