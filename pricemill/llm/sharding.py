"""Sharding by histogram sort: exact byte counts below probes, refined until splitters are close enough.

The sort key of a row is (hash of its text, its id), so equal texts lie side by side. A splitter is a
key; the bytes below it must be within a tolerance of the wanted share. Every round counts the exact
bytes and rows between probes in one pass over the narrow keys, pre-aggregated in the tasks, and
puts new probes only between the two keys that bracket a splitter. When all splitters are found the
rows are exchanged once, sorted inside their bucket and numbered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from pricemill.session import stage

SHARDS = 24
# A splitter may miss its share by this part of a shard, unless a single row is larger.
TOLERANCE = 0.001
# Buckets into which shards are cut for the exchange, so that a task's share does not grow with the data.
BUCKET_BYTES = 8 << 20
# Most buckets; beyond, buckets grow and their sort spills. Also bounds what the driver keeps.
MAX_BUCKETS = 4096
# Probes of a round over all splitters together.
PROBES = 1 << 16
HIGH = (1 << 128) - 1

CELL = "cell int, bytes bigint, first binary, last binary"


def _pack(key: int) -> bytes:
    return key.to_bytes(16, "big")


def _keys(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Both signed halves as 16-byte strings whose byte order is the numeric order."""
    sign = np.uint64(1 << 63)
    halves = np.empty((len(high), 2), dtype=">u8")
    halves[:, 0] = high.astype(np.int64).view(np.uint64) ^ sign
    halves[:, 1] = low.astype(np.int64).view(np.uint64) ^ sign
    return halves.reshape(-1).view("S16")


def _cells(probes: list[int]):
    """A task function that sums sizes between neighbouring probes; one row per cell and batch."""
    bounds = np.frombuffer(b"".join(map(_pack, probes)), dtype="S16")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            high, low, size = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            keys = _keys(high, low)
            order = np.argsort(keys, kind="stable")
            keys, size = keys[order], size[order]
            cell = np.searchsorted(bounds, keys, side="right")
            starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            ends = np.r_[starts[1:], len(cell)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(cell[starts].astype(np.int32)),
                    pa.array(np.add.reduceat(size, starts).astype(np.int64)),
                    pa.array([bytes(k).ljust(16, b"\0") for k in keys[starts]], pa.binary()),
                    pa.array([bytes(k).ljust(16, b"\0") for k in keys[ends - 1]], pa.binary()),
                ],
                names=["cell", "bytes", "first", "last"],
            )

    return run


def _count_cells(keys: DataFrame, probes: list[int]) -> list[tuple[int, int, int, int]]:
    """(cell, bytes, first key, last key) of the cells that hold rows; as many rows as probes at most."""
    cells = keys.mapInArrow(_cells(probes), CELL).groupBy("cell")
    summed = cells.agg(F.sum("bytes"), F.min("first"), F.max("last")).collect()
    return sorted((r[0], r[1], int.from_bytes(r[2], "big"), int.from_bytes(r[3], "big")) for r in summed)


def find_splitters(keys: DataFrame, pieces: int, tolerance: float = TOLERANCE, probes: int = PROBES) -> list[int]:
    """Keys ``s`` so that the rows below each hold its share of all bytes, up to ``tolerance`` of a piece.

    ``keys`` has two bigint key columns and a bigint size. The driver keeps a few numbers per
    splitter and probe. Where one row is larger than the tolerance, the splitter lies on the nearer side of it.
    """
    cells = _count_cells(keys, [])
    if not cells:
        return []
    total = cells[0][1]
    allowed = tolerance * total / pieces
    wanted = [total * (i + 1) // pieces for i in range(pieces - 1)]
    found: dict[int, int] = {}
    # for each open splitter: lowest and highest key that may hold it, and the bytes below the lowest
    brackets = {i: (cells[0][2], cells[0][3] + 1, 0) for i in range(pieces - 1)}
    while brackets:
        marks: set[int] = set()
        each = max(4, min(256, probes // len(brackets)))
        for low, high, _ in set(brackets.values()):
            marks.add(low)
            marks.add(high)
            marks.update(low + (high - low) * k // each for k in range(1, each))
        ordered = sorted(marks)
        counted = _count_cells(keys, ordered)
        below, at = 0, {}
        edges = []  # (bytes below the cell, its bytes, first key, last key)
        for _, size, first, last in counted:
            edges.append((below, size, first, last))
            below += size
        position = 0
        for i in sorted(brackets):
            goal = wanted[i]
            while position < len(edges) - 1 and edges[position][0] + edges[position][1] < goal:
                position += 1
            before, size, first, last = edges[position]
            under, over = goal - before, before + size - goal
            if min(under, over) <= allowed or first == last:
                found[i] = first if under <= over else min(last + 1, HIGH)
            else:
                at[i] = (first, last + 1, before)
        brackets = at
    return [found[i] for i in range(pieces - 1)]


def _place(splitters: list[int]):
    bounds = np.frombuffer(b"".join(map(_pack, splitters)), dtype="S16")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            high, low = (
                batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
                for c in ("_llm_hash", "_llm_id")
            )
            bucket = np.searchsorted(bounds, _keys(high, low), side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bucket)], names=[*batch.schema.names, "_llm_bucket"])

    return run


def _with_bucket(df: DataFrame) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField("_llm_bucket", T.IntegerType())])


def shard_by_bytes(
    docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text",
    bucket_bytes: int = BUCKET_BYTES, tolerance: float = TOLERANCE,
) -> DataFrame:
    """Append ``size`` (UTF-8 bytes of the text plus 8), ``shard`` and ``slot`` (gapless from 0 in each shard).

    Shards hold near-equal bytes. A group of equal texts stays together unless a splitter falls into
    it. A null id sorts as the lowest; rows of equal id and text cannot be told apart and share a
    bucket. The exchange deals out buckets, which are parts of shards.
    """
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("bigint")
    keyed = docs.withColumns(
        {
            "size": size,
            "_llm_hash": F.xxhash64(F.coalesce(F.col(text), F.lit(""))),
            "_llm_id": F.coalesce(F.col(key).cast("bigint"), F.lit(-(1 << 63))),
        }
    )
    keys = stage(keyed.select("_llm_hash", "_llm_id", "size"), "shard-keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    cut = max(1, min(MAX_BUCKETS // shards, -(-total // (shards * bucket_bytes))))
    pieces = shards * cut
    splitters = find_splitters(keys, pieces, tolerance)
    placed = keyed.mapInArrow(_place(splitters), _with_bucket(keyed))
    counts = (
        keys.mapInArrow(_place(splitters), _with_bucket(keys))
        .groupBy("_llm_bucket").agg(F.count(F.lit(1)).alias("_llm_n"))
        .withColumn("_llm_shard", F.floor(F.col("_llm_bucket") / cut))
    )
    before = Window.partitionBy("_llm_shard").orderBy("_llm_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_llm_bucket", F.coalesce(F.sum("_llm_n").over(before), F.lit(0)).alias("_llm_before"))
    inside = Window.partitionBy("_llm_bucket").orderBy("_llm_hash", "_llm_id")
    exchanged = placed.repartition(pieces, "_llm_bucket").withColumn("_llm_row", F.row_number().over(inside))
    return (
        exchanged.join(F.broadcast(offsets), "_llm_bucket")  # at most MAX_BUCKETS rows
        .withColumns(
            {
                "shard": F.floor(F.col("_llm_bucket") / cut).cast("int"),
                "slot": (F.col("_llm_before") + F.col("_llm_row") - 1).cast("bigint"),
            }
        )
        .drop("_llm_bucket", "_llm_before", "_llm_row", "_llm_hash", "_llm_id")
    )
