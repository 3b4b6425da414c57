"""Embedding whitening: a covariance from tiles of dimension pairs, its eigenvectors, and the vectors projected on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import cut, parallelism, prepare, reads

#: x = floor(SCALE * entry) + SHIFT; entries of LARGEST or more have no x that a long can hold.
SCALE, SHIFT, LARGEST = 1024, 100_000, float(1 << 52)
#: Rows of a row block.
BLOCK_ROWS = 1024
#: Eigenvalues at most this part of the largest count as none.
NO_SPREAD = 1e-12


def usable(column: str = "embedding") -> F.Column:
    """Whether a vector is there, has entries, and all of them are finite and below LARGEST in size."""
    return F.coalesce((F.size(column) > 0) & F.forall(column, lambda v: F.coalesce(F.abs(v.cast("double")) < LARGEST, F.lit(False)) & ~F.isnan(v.cast("double"))), F.lit(False))


def _matrix(batch: pa.RecordBatch, column: str, dims: int, exact: bool) -> np.ndarray:
    """The vectors of a batch as rows: x as int64 where exact, or the entries as they are."""
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    return np.floor(flat * SCALE).astype(np.int64) + SHIFT if exact else flat


def _sums(column: str, dims: int, exact: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high, plain = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64), np.zeros(dims)
        for batch in batches:
            x = _matrix(batch, column, dims, exact)
            n += len(x)
            if exact:  # in halves, so that 2^31 rows of any size do not overflow
                low += (x & 0x7FFFFFFF).sum(0)
                high += (x >> 31).sum(0)
            else:
                plain += x.sum(0)
        if n:
            if exact:
                total = [Decimal(int(h) * (1 << 31) + int(v)) for h, v in zip(high, low, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()), pa.array(total, pa.decimal128(38, 0))], names=["dim", "n", "total"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()), pa.array(plain)], names=["dim", "n", "total"])

    return run


def sums(vectors: DataFrame, column: str, dims: int, exact: bool) -> tuple[int, list]:
    """(rows, sum of each dimension): one row for each dimension comes to the driver."""
    parts = vectors.select(column).mapInArrow(_sums(column, dims, exact), f"dim int, n long, total {'decimal(38,0)' if exact else 'double'}")
    found = {r.dim: r for r in parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()}
    return (found[0].n if found else 0), [(int(found[d].total) if exact else found[d].total) if found else 0 for d in range(dims)]


def _centred(x: np.ndarray, n: int, total: list) -> np.ndarray:
    """x - total / n in double precision, without taking large numbers from each other in double precision."""
    if x.dtype.kind == "f":
        return x - np.array(total) / n
    whole = np.array([t // n for t in total], np.int64)
    return (x - whole) - np.array([float(Fraction(t % n, n)) for t in total])


TILE = "tile int, rows long, height int, one binary, other binary"
PRODUCT = "tile int, rows long, product binary"


def _blocks(column: str, dims: int, exact: bool, width: int) -> Callable:
    """Column blocks of each row block, sent to each tile that they are one side of, both sides in one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        starts = range(0, dims, width)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                x = _matrix(batch.slice(at, BLOCK_ROWS), column, dims, exact)
                if exact and np.abs(x).max() < 1 << 31:
                    x = x.astype(np.int32)  # half the bytes to shuffle
                kind = x.dtype.str.encode() + b":"
                columns = [kind + np.ascontiguousarray(x[:, s : s + width]).tobytes() for s in starts]
                tile = 0
                for i in range(len(starts)):
                    for j in range(i, len(starts)):
                        yield pa.RecordBatch.from_arrays([pa.array([tile], pa.int32()), pa.array([number], pa.int64()), pa.array([len(x)], pa.int32()), pa.array([columns[i]], pa.binary()), pa.array([columns[j] if j > i else b""], pa.binary())], names=["tile", "rows", "height", "one", "other"])
                        tile += 1
                number += 1

    return run


def _multiply(n: int, total: list, pairs: list[tuple[int, int]], width: int) -> Callable:
    """Products of centred column blocks, summed while the rows of a tile last; rows come tile by tile."""

    def block(data: bytes, height: int, start: int) -> np.ndarray:
        kind, _, rest = data.partition(b":")
        x = np.frombuffer(rest, np.dtype(kind.decode())).reshape(height, -1)
        return _centred(x if x.dtype.kind == "f" else x.astype(np.int64), n, total[start : start + width])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, held = None, 0, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([first], pa.int64()), pa.array([held.tobytes()], pa.binary())], names=["tile", "rows", "product"])
        for batch in batches:
            for r in batch.to_pylist():
                if r["tile"] != now:
                    if now is not None:
                        yield out()
                    now, first, held = r["tile"], r["rows"], 0.0
                i, j = pairs[now]
                a = block(r["one"], r["height"], i * width)
                held = held + a.T @ (block(r["other"], r["height"], j * width) if r["other"] else a)
        if now is not None:
            yield out()

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the products of each tile, which come tile by tile."""
    now, held = None, None
    out = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([0], pa.int64()), pa.array([held.tobytes()], pa.binary())], names=["tile", "rows", "product"])
    for batch in batches:
        for tile, product in zip(batch.column("tile").to_pylist(), batch.column("product").to_pylist(), strict=True):
            if tile != now:
                if now is not None:
                    yield out()
                now, held = tile, 0.0
            held = held + np.frombuffer(product)
    if now is not None:
        yield out()


def tiled_covariance(vectors: DataFrame, column: str, dims: int, n: int, total: list, width: int, exact: bool = False) -> np.ndarray:
    """Covariance of the column's vectors (divisor n), centred before they are multiplied.

    Dimensions are cut into blocks of ``width``; each pair of blocks is a tile.  Column blocks are shuffled by tile and row block, so
    a tile's work is spread over all tasks whatever the number of rows; products are summed per task and then per tile.  Only the
    tiles' sums, dims x dims numbers, come to the driver.
    """
    spark = vectors.sparkSession
    starts = range(0, dims, width)
    pairs = [(i, j) for i in range(len(starts)) for j in range(i, len(starts))]
    p = parallelism(spark)
    dealt = vectors.select(column).mapInArrow(_blocks(column, dims, exact, width), TILE).repartition(p, "tile", "rows").sortWithinPartitions("tile", "rows")
    products = dealt.mapInArrow(_multiply(n, total, pairs, width), PRODUCT)
    tiles = products.repartition(min(p, len(pairs)), "tile").sortWithinPartitions("tile", "rows").mapInArrow(_add, PRODUCT)
    out = np.zeros((dims, dims))
    for r in tiles.collect():  # dims x dims numbers in all
        i, j = (pairs[r.tile][0] * width, pairs[r.tile][1] * width)
        got = np.frombuffer(bytes(r.product)).reshape(min(width, dims - i), -1) / n
        out[i : i + width, j : j + width] = got
        out[j : j + width, i : i + width] = got.T
    return (out + out.T) / 2


def _project(dims: int, n: int, total: list, axes: np.ndarray) -> Callable:
    """Whitened coordinates and the exact sum of squares of n x - total."""
    whole, rest = np.array([t // n for t in total], np.int64), [t % n for t in total]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, "embedding", dims, True)
            near = x - whole
            most = (int(np.abs(near).max()) + 1) * n if len(x) else 0
            if most < 1 << 62 and most * most * dims < 1 << 63:
                d = near * n - np.array(rest, np.int64)
                deviation = [Decimal(v) for v in (d * d).sum(1).tolist()]
            else:
                deviation = [Decimal(sum((v * n - s) ** 2 for v, s in zip(row, rest, strict=True))) for row in near.tolist()]
            deviation = [v if abs(v) < 10**38 else None for v in deviation]
            w = _centred(x, n, total) @ axes
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(deviation, pa.decimal128(38, 0)), pa.array(list(w), pa.list_(pa.float64()))], names=["vec_id", "deviation", "whitened"])

    return run


def principal_axes(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of the first ``most`` components, falling; signs make the largest entry positive."""
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:most]
    values, vectors = values[order], vectors[:, order]
    real = values > max(values[0], 0.0) * NO_SPREAD
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return values[real], vectors[:, real]


def whiten(table: DataFrame, components: int = 8, width: int = 32) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every row and component of embeddings (vec_id, embedding).

    Dropped are null and empty vectors, those with an entry that is null, not finite or of LARGEST and more in size, and those whose
    length is not the most frequent one (the longer of two as frequent).  Repeated rows and rows with a null or repeated vec_id
    each count and come back.  Components without spread (an eigenvalue of at most NO_SPREAD of the largest) have no rows, so
    equal vectors, a single vector or an empty table give none; of equal eigenvalues any axes may be taken, the same for all rows.
    ``deviation`` is exact, as decimal(38,0), null beyond that.  ``identity_error`` comes from the whitened vectors themselves, by
    a second tiled covariance.  Other columns are left alone.
    """
    spark = prepare(table.sparkSession)
    vectors = table.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(usable())
    schema = f"vec_id {dict(table.dtypes)['vec_id']}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    lengths = vectors.groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    dims = lengths.dims
    vectors = vectors.where(F.size("embedding") == dims)
    n, total = sums(vectors, "embedding", dims, True)
    covariance = tiled_covariance(vectors, "embedding", dims, n, total, width, True)
    values, axes = principal_axes(covariance, components)
    k = len(values)
    if not k:
        return spark.createDataFrame([], schema)
    projected = cut(vectors.mapInArrow(_project(dims, n, total, axes / np.sqrt(values)), f"vec_id {dict(table.dtypes)['vec_id']}, deviation decimal(38,0), whitened array<double>"), "whitened")
    _, means = sums(projected, "whitened", k, False)
    error = float(np.abs(tiled_covariance(projected, "whitened", k, n, means, width) - np.eye(k)).max())
    explained = F.element_at(F.array(*[F.lit(float(v)) for v in values / np.trace(covariance)]), F.col("component"))
    out = projected.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).withColumn("component", F.col("at") + 1)
    return reads(out.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error")), projected)
