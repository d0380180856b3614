"""Embedding whitening by a tiled covariance.

Entries become the integers x = floor(1024 c) + 100000. A first pass counts the
vectors and adds up every dimension, exactly. For the covariance, tasks cut
their rows into row-blocks of about ``ROW_BLOCK_BYTES`` and every row-block into
column blocks of ``tile`` dimensions. The pairs of dimensions are parted into
tile keys (I, J), I <= J, by the same width. The column blocks are shuffled by
row-block; where those of a row-block meet, they are centred and every tile pair
is multiplied. A task adds its products for each tile, a second shuffle by tile
adds those of all tasks, and the driver assembles the matrix and decomposes it:
what it receives has the size of the matrix, whatever the number of rows.

Rows are then projected on the components, and the covariance of what came out is
measured, centred before multiplying, and compared with the identity.

Defined cases: a vector that is null, or holds a null or non-finite entry, or one
whose integer exceeds 2^52, is dropped. So is one whose length is not that of
most vectors (of equally frequent lengths the greatest counts), empty ones
included. Rows with one id, or without an id, count as often as they come.
A component whose eigenvalue is zero to working precision (fewer
independent vectors than dimensions, or copies only) has a null ``whitened`` and stays out
of ``identity_error``. An empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SCALE, SHIFT, LARGEST = 1024, 100_000, 1 << 52
#: Bytes of a row-block as float64: what a task multiplies at once.
ROW_BLOCK_BYTES = 4 << 20
TILE = 32


class Fit(NamedTuple):
    """What the vectors have in common: their number, exact sums, covariance and components by falling eigenvalue."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray  # a column for each component
    rank: int


def _integers(column: pa.Array, dims: int | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """The rows whose vector counts, and their integers; with ``dims`` as one matrix of that width, else a matrix for each length."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    values = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(values * SCALE)
        fine = np.isfinite(values) & (np.abs(scaled) <= LARGEST)
    starts = np.cumsum(lengths) - lengths
    bad = np.concatenate([[0], np.cumsum(~fine)])
    sound = (lengths > 0) & (bad[starts + lengths] == bad[starts])
    rows, found = [], []
    for d in [dims] if dims else np.unique(lengths[sound]).tolist():
        at = np.flatnonzero(sound & (lengths == d))
        rows.append(at)
        found.append(scaled[starts[at][:, None] + np.arange(d)].astype(np.int64) + SHIFT)
    return np.concatenate(rows) if rows else np.zeros(0, np.int64), found


def _vectors(table: DataFrame, vector_col: str):
    return F.col(vector_col).cast("array<double>").alias("vector")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each length of vectors in a task: their number and the sum of each dimension, as decimal text."""
    total: dict[int, tuple[int, list[int]]] = {}
    for batch in batches:
        for x in _integers(batch.column("vector"))[1]:
            # upper and lower halves apart, so that nothing overflows
            high, low = (x >> 26).sum(0).tolist(), (x & ((1 << 26) - 1)).sum(0).tolist()
            n, before = total.get(x.shape[1], (0, [0] * x.shape[1]))
            total[x.shape[1]] = (n + len(x), [b + (h << 26) + k for b, h, k in zip(before, high, low)])
    if total:
        yield pa.RecordBatch.from_pydict({"dims": pa.array(list(total), pa.int32()), "n": pa.array([n for n, _ in total.values()], pa.int64()), "sums": pa.array([[str(s) for s in sums] for _, sums in total.values()], pa.list_(pa.string()))})


def _centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """x less the whole part of each mean, as integers, and what is left of the means, below one."""
    whole = [s // n for s in sums]
    return x - np.array(whole, np.int64), np.array([(s - n * w) / n for s, w in zip(sums, whole)])


def _tile_batch(total: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
    keys = list(total)
    return pa.RecordBatch.from_pydict({"i": pa.array([i for i, _ in keys], pa.int32()), "j": pa.array([j for _, j in keys], pa.int32()), "data": pa.array([total[k].astype("<f8").tobytes() for k in keys], pa.binary())})


def covariance(vectors: DataFrame, n: int, sums: list[int], tile: int = TILE) -> np.ndarray:
    """Covariance (divisor n) of the integers of a column ``vector``, all of ``len(sums)`` entries or dropped, by tiles."""
    dims = len(sums)
    per_block = max(1, ROW_BLOCK_BYTES // (8 * dims))
    left = np.array([(s - n * (s // n)) / n for s in sums])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, number = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            x = _integers(batch.column("vector"), dims)[1][0]
            for a in range(0, len(x), per_block):
                y = _centred(x[a : a + per_block], n, sums)[0]
                if (np.abs(y) < 1 << 15).all():
                    y = y.astype("<i2")
                elif (np.abs(y) < 1 << 31).all():
                    y = y.astype("<i4")
                for c in range(0, dims, tile):
                    block = np.ascontiguousarray(y[:, c : c + tile])
                    yield pa.RecordBatch.from_pydict({"row_block": pa.array([base + number], pa.int64()), "column_block": pa.array([c // tile], pa.int32()), "width": pa.array([block.itemsize], pa.int32()), "data": pa.array([block.tobytes()], pa.binary())})
                number += 1

    def multiply(met: pa.Table) -> pa.Table:
        """Products of all tile pairs of one row-block."""
        blocks = {}
        for c, width, data in zip(*(met.column(k).to_pylist() for k in ("column_block", "width", "data"))):
            part = slice(c * tile, min(dims, (c + 1) * tile))
            blocks[c] = np.frombuffer(data, f"<i{width}").reshape(-1, part.stop - part.start).astype(np.float64) - left[part]
        return pa.Table.from_batches([_tile_batch({(i, j): blocks[i].T @ blocks[j] for i in blocks for j in blocks if i <= j})])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for i, j, data in zip(*(batch.column(k).to_pylist() for k in range(3))):
                part = np.frombuffer(data, "<f8")
                total[i, j] = total[i, j] + part if (i, j) in total else part
        if total:
            yield _tile_batch(total)

    blocks = vectors.mapInArrow(cut, "row_block long, column_block int, width int, data binary")
    kind = "i int, j int, data binary"
    tiles = blocks.groupBy("row_block").applyInArrow(multiply, kind).mapInArrow(add, kind).repartition("i", "j").mapInArrow(add, kind)
    out = np.zeros((dims, dims))
    for row in tiles.collect():  # the matrix itself
        a, b = (slice(k * tile, min(dims, (k + 1) * tile)) for k in (row.i, row.j))
        part = np.frombuffer(row.data, "<f8").reshape(a.stop - a.start, b.stop - b.start) / n
        out[a, b], out[b, a] = part, part.T
    return out


def fit(table: DataFrame, vector_col: str = "embedding", tile: int = TILE) -> Fit | None:
    """The fit over every vector that counts, or None where there is none."""
    vectors = table.select(_vectors(table, vector_col))
    partial = common.scratch(vectors.mapInArrow(_sums, "dims int, n long, sums array<string>"), "sums")
    most = partial.groupBy("dims").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if most is None:
        return None
    each = partial.where(F.col("dims") == most.dims).select(F.posexplode("sums").alias("k", "s"))
    found = each.groupBy("k").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # a row for each dimension
    sums = [int(r.s) for r in sorted(found, key=lambda r: r.k)]
    matrix = covariance(vectors, most.n, sums, tile)
    values, basis = np.linalg.eigh(matrix)
    values, basis = values[::-1], basis[:, ::-1]
    rank = int((values > max(values[0], 0) * len(sums) * np.finfo(float).eps * 8).sum()) if values[0] > 0 else 0
    return Fit(most.n, sums, matrix, values, basis, rank)


def whiten(table: DataFrame, components: int = 8, vector_col: str = "embedding", tile: int = TILE) -> DataFrame:
    """Each row that counts, as a struct ``row``, with n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double.

    ``whitened`` has the first ``components`` components, fewer where the vectors have fewer dimensions. It is
    written to the shared folder once, to be measured. Memory of a task: an Arrow batch of rows.
    """
    made = fit(table, vector_col, tile)
    rows = table.select(F.struct(*(F.col(f"`{c}`") for c in table.columns)).alias("row"), _vectors(table, vector_col))
    kind = rows.schema["row"].dataType.simpleString()
    schema = f"row {kind}, deviation decimal(38,0), whitened array<double>"
    if made is None:
        empty = rows.where("false").select("row", F.lit(None).cast("decimal(38,0)").alias("deviation"), F.lit(None).cast("array<double>").alias("whitened"))
        return empty.withColumns({"n": F.lit(0).cast("long"), "explained": F.lit(None).cast("array<double>"), "identity_error": F.lit(0.0)})
    n, sums, dims, rank = made.n, made.sums, len(made.sums), made.rank
    count = min(components, dims)
    scale = np.array([1 / np.sqrt(made.values[k]) if k < rank else np.nan for k in range(count)])
    basis = np.ascontiguousarray(made.vectors[:, :count])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = [s // n for s in sums]
        rest = [s - n * w for s, w in zip(sums, whole)]
        for batch in batches:
            at, (x,) = _integers(batch.column("vector"), dims)
            y, left = _centred(x, n, sums)
            z = ((y - left) @ basis) * scale
            most = int(np.abs(y).max()) if y.size else 0
            if dims * (n * (most + 1)) ** 2 < 1 << 63:
                deviation = ((n * y - np.array(rest, np.int64)) ** 2).sum(1).tolist()
            else:
                deviation = [sum((n * v - r) ** 2 for v, r in zip(line, rest)) for line in y.tolist()]
            flat = pa.array(z.ravel(), pa.float64(), from_pandas=True)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * count, pa.int32()), flat)
            row = batch.column("row").take(pa.array(at))
            yield pa.RecordBatch.from_arrays([row, pa.array([str(v) for v in deviation], pa.string()).cast(pa.decimal128(38, 0)), listed], names=["row", "deviation", "whitened"])

    white = common.scratch(rows.mapInArrow(project, schema), "whitened")
    used = min(count, rank)
    error = 0.0
    if used:
        means = white.select(*(F.avg(F.col("whitened")[k]).alias(f"m{k}") for k in range(used))).first()
        pairs = [(i, j) for i in range(used) for j in range(i, used)]
        products = white.select(*(F.avg((F.col("whitened")[i] - means[i]) * (F.col("whitened")[j] - means[j])).alias(f"c{i}_{j}") for i, j in pairs)).first()
        error = max(abs(v - (i == j)) for (i, j), v in zip(pairs, products))
    trace = float(np.trace(made.covariance))
    explained = [float(max(made.values[k], 0) / trace) if trace > 0 else 0.0 for k in range(count)]
    return white.withColumns({"n": F.lit(n).cast("long"), "explained": F.array(*map(F.lit, explained)), "identity_error": F.lit(float(error))})


def component_rows(white: DataFrame) -> DataFrame:
    """What ``whiten`` gave as a row for each vector and component, numbered from 1."""
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("k", "c")
    return white.select("row", "n", "deviation", "identity_error", each).select("row", (F.col("k") + 1).alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")
