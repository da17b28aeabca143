"""Whitening of vectors with MLlib's distributed block matrices.

Components become integers, so that sums are exact and rows can be centred without loss. Centred rows
are dealt into blocks of equal height, numbered and written once; a row's index is its block and its
place in it, and a block that is not full ends in rows of zeros, which add nothing to a product. The transposed matrix
times the matrix is the scatter matrix; its eigenvectors are found on the driver (its size is that
of a vector, squared), and the matrix times the whitening matrix projects the rows.
"""

from __future__ import annotations

import decimal
import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, functions as F

from pricemill.llm.vectors import bytes_column, length_of, matrix, usable
from pricemill.session import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Entries of a block, columns of a block, and blocks of a task of a product over rows.
BLOCK_ENTRIES = 1 << 17
BLOCK_COLUMNS = 1024
BLOCKS_A_TASK = 32
# Components of this size or more don't take part: sums of a batch must fit 64 bits.
LARGEST = float(1 << 34)
# A component whose variance is below this share of the largest can't be told from rounding.
LEAST_VARIANCE = 1e-10

_RESULT = "vec_id bigint, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"


def _integers(length: int, factor: int, shift: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1)
            rows = np.flatnonzero(usable(vectors, length))
            values = matrix(vectors, rows, length)
            fits = (np.abs(values) < LARGEST).all(axis=1)
            rows, x = rows[fits], np.floor(factor * values[fits]).astype(np.int64) + shift
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), bytes_column(x)], names=["id", "x"])

    return run


def _read(column: pa.Array | pa.ChunkedArray, kind: type, length: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, length)


def _partial_sums(length: int):
    """The number of rows and the sums of each batch, sums as digits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = _read(batch.column(1), np.int64, length).sum(axis=0)
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.num_rows]), pa.array([sums.tolist()], pa.list_(pa.int64()))], names=["n", "sums"]
            )

    return run


def _centred(n: int, sums: list[int], length: int):
    """One row for each block: ids, exact deviations, and the centred rows ``(n * x - sums) / n``."""
    largest = n * 2 * (int(LARGEST) << 7) + max(map(abs, sums), default=0)
    total = np.array(sums, np.int64 if largest < 1 << 62 else object)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        x = _read(table["x"], np.int64, length).astype(total.dtype)
        scaled = n * x - total
        widest = int(np.abs(scaled).max())
        exact = scaled if length * widest**2 < 1 << 62 else scaled.astype(object)
        deviations = (exact * exact).sum(axis=1)
        rows = scaled.astype(np.float64) / n
        return pa.table({
            "block": pa.array([key[0].as_py()], pa.int32()), "ids": pa.array([table["id"].to_pylist()], pa.list_(pa.int64())),
            "deviations": pa.array([[decimal.Decimal(int(d)) for d in deviations]], pa.list_(pa.decimal128(38, 0))),
            "rows": pa.array([rows.tobytes()], pa.binary()),
        })

    return run


def _height(blocks: DataFrame) -> int:
    return blocks.agg(F.max(F.size("ids"))).first()[0]


def block_matrix(blocks: DataFrame, height: int, width: int, mean: np.ndarray | None = None) -> BlockMatrix:
    """The rows of all blocks, less ``mean``, as one matrix; short blocks end in zeros."""

    def parts(row) -> Iterator[tuple[tuple[int, int], DenseMatrix]]:
        own = np.frombuffer(row["rows"], np.float64).reshape(-1, width)
        padded = np.zeros((height, width))
        padded[: len(own)] = own if mean is None else own - mean
        for at in range(0, width, BLOCK_COLUMNS):
            part = padded[:, at : at + BLOCK_COLUMNS]
            yield (row["block"], at // BLOCK_COLUMNS), DenseMatrix(height, part.shape[1], part.ravel(order="F"))

    made = BlockMatrix(blocks.select("block", "rows").rdd.flatMap(parts), height, min(width, BLOCK_COLUMNS))
    # a product reads its matrices several times; what a lost executor kept is made again from the written blocks
    return made.persist(StorageLevel.MEMORY_AND_DISK)


def _release(matrix_: BlockMatrix) -> None:
    matrix_._java_matrix_wrapper._java_model.blocks().unpersist(False)


def local_matrix(values: np.ndarray, spark) -> BlockMatrix:
    """A small matrix as blocks, cut as the columns of :func:`block_matrix` are."""
    cut = [values[at : at + BLOCK_COLUMNS] for at in range(0, len(values), BLOCK_COLUMNS)]
    blocks = [((i, 0), DenseMatrix(*part.shape, part.ravel(order="F"))) for i, part in enumerate(cut)]
    return BlockMatrix(spark.sparkContext.parallelize(blocks, len(blocks)), min(len(values), BLOCK_COLUMNS), values.shape[1])


def scatter(rows: BlockMatrix, blocks: int) -> np.ndarray:
    """The transposed matrix times the matrix.

    All row blocks meet in one small result, so the product over them is split among tasks; sums of
    parts are added afterwards. (The split is an argument of the method on the JVM side only.)
    """
    left, right = (m._java_matrix_wrapper._java_model for m in (rows.transpose(), rows))
    product = left.multiply(right, max(1, math.ceil(blocks / BLOCKS_A_TASK)))
    return BlockMatrix(product, rows.colsPerBlock, rows.colsPerBlock).toLocalMatrix().toArray()


def _projected(rows: BlockMatrix, whitening: np.ndarray, spark) -> RDD:
    """(block, its projected rows as bytes)."""
    product = rows.multiply(local_matrix(whitening, spark))
    return product.blocks.map(lambda b: (int(b[0][0]), bytearray(np.ascontiguousarray(b[1].toArray()).tobytes())))


def _column_means(blocks: DataFrame, width: int, n: int) -> np.ndarray:
    sums = blocks.select("rows").rdd.map(lambda r: np.frombuffer(r["rows"], np.float64).reshape(-1, width).sum(axis=0))
    return sums.treeReduce(np.add) / n


def _long(n: int, explained: list[float], error: float):
    """A row for each vector and component."""
    width = len(explained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, deviations, rows in zip(*(c for c in batch.columns), strict=True):
                values = np.frombuffer(rows.as_py(), np.float64)
                count = len(values) // width
                repeated = np.repeat(np.arange(count), width)
                yield pa.RecordBatch.from_arrays([
                    ids.values.take(pa.array(repeated)), pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), count)),
                    pa.array(np.full(len(values), n)), deviations.values.take(pa.array(repeated)), pa.array(values),
                    pa.array(np.tile(explained, count)), pa.array(np.full(len(values), error)),
                ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whiten(
    vectors: DataFrame, components: int = 32, factor: int = 64, shift: int = 1_000_000, id_column: str = "vec_id", column: str = "embedding"
) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``.

    ``x = floor(factor * component) + shift``. ``whitened`` is the projection of the centred ``x`` on the unit eigenvector of its
    covariance (divisor n) with the ``component``-th largest eigenvalue, over the root of the eigenvalue; ``explained`` is the
    eigenvalue's share of the trace; ``deviation`` is the exact sum of ``(n * x - S)^2`` over all dimensions, and
    ``identity_error`` the largest entry of the covariance of ``whitened`` less the identity.

    Rows with a null vector, a null or non-finite entry, an entry of 2^34 or more, or another length than most are dropped. Other columns are not read;
    repeated rows and null ids count like others. Eigenvalues below ``LEAST_VARIANCE`` of the largest (constant
    or dependent dimensions) give no component, so equal vectors give no rows. An empty table gives an empty one.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).cast("bigint").alias("id"), F.col(column).alias("vector"))
    length = length_of(rows, "vector")
    nothing = spark.createDataFrame([], _RESULT)
    if not length:
        return nothing
    integers = stage(rows.mapInArrow(_integers(length, factor, shift), "id bigint, x binary"), "integers")
    partial = integers.mapInArrow(_partial_sums(length), "n bigint, sums array<bigint>")
    sums = partial.select("n", F.posexplode("sums").alias("at", "s")).groupBy("at").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")
    ).orderBy("at").collect()
    n = sums[0]["n"] if sums else 0
    if not n:
        return nothing
    # a block is a little smaller than the wanted height, for the lot decides how many rows it gets
    count = math.ceil(n / (max(1, BLOCK_ENTRIES // min(length, BLOCK_COLUMNS)) * 3 / 4))
    lot = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(count)).cast("int")
    dealt = integers.withColumn("block", lot).groupBy("block")
    made = dealt.applyInArrow(_centred(n, [int(r["s"]) for r in sums], length), "block int, ids array<bigint>, deviations array<decimal(38,0)>, rows binary")
    centred = stage(made, "centred-blocks")
    height = _height(centred)
    matrix_ = block_matrix(centred, height, length)
    covariance = scatter(matrix_, count) / n
    values, directions = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > LEAST_VARIANCE * max(0.0, values.max())]
    if not len(order):
        return nothing
    projected = spark.createDataFrame(_projected(matrix_, directions[:, order] / np.sqrt(values[order]), spark), "block int, rows binary")
    width = len(order)
    trimmed = F.expr(f"substring(rows, 1, size(ids) * {8 * width})")
    whitened = stage(centred.drop("rows").join(projected, "block").withColumn("rows", trimmed), "whitened-blocks")
    _release(matrix_)
    again = block_matrix(whitened, height, width, _column_means(whitened, width, n))
    error = float(np.abs(scatter(again, count) / n - np.eye(width)).max())
    _release(again)
    explained = (values[order] / np.trace(covariance)).tolist()
    return whitened.select("ids", "deviations", "rows").mapInArrow(_long(n, explained, error), _RESULT)
