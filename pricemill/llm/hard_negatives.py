"""Hard negatives by the method of the Four Russians.

Components become integers, and an integer is a handful of bits. The bits of one weight of a
candidate's components are its bit plane; eight components of a plane are one byte. What an anchor's eight components
add up to under each of the 256 possible bytes is tabulated once. A score is then read, not multiplied: for
every plane, from the highest weight to the lowest, double what there is and add the table entries that
the plane's bytes point to. The highest plane counts negatively (two's complement). So the scores are
the exact integer inner products.

Anchors come in blocks of a fixed size. For a block the tables go to all tasks, which score all
candidates against them and keep, for each anchor, no more rows than are asked for. Two readings of
the candidates are needed: the limits of the negatives depend on the positives.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from pricemill.llm.vectors import bytes_column, length_of, matrix, usable
from pricemill.session import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Anchors whose tables a task holds: 2048 entries of four or eight bytes for 64 components each.
ANCHORS = 1024
# Candidates scored at a time.
CHUNK = 1024
# Scaled components lie between -LARGEST and LARGEST, so that a score and a place in a chunk fit 64 bits.
LARGEST = 1 << 20

_PACKED = "id bigint, label bigint, planes binary"
_SCORED = "slot int, id bigint, score bigint"


def pack_planes(values: np.ndarray, bits: int) -> np.ndarray:
    """The bit planes of integer rows, lowest weight first, eight components a byte: (rows, planes, bytes)."""
    rows, length = values.shape
    padded = np.zeros((rows, -length % 8 + length), np.int64)
    padded[:, :length] = values
    planes = (padded[:, None, :] >> np.arange(bits)[None, :, None]) & 1
    return np.packbits(planes.astype(np.uint8), axis=2, bitorder="little")


def unpack_planes(planes: np.ndarray) -> np.ndarray:
    """The integers that planes (rows, planes, bytes) stand for; components are padded with zeros to whole bytes."""
    bits = np.unpackbits(planes, axis=2, bitorder="little").astype(np.int64)
    weights = np.left_shift(1, np.arange(planes.shape[1], dtype=np.int64))
    weights[-1] = -weights[-1]
    return np.einsum("rpc,p->rc", bits, weights)


def subset_sums(anchors: np.ndarray, kind: type = np.int64) -> np.ndarray:
    """For each group of eight components and each byte, the sum of the components that its bits choose:
    (groups, 256, anchors). Every entry is one addition to an entry with a bit less."""
    count, length = anchors.shape
    grouped = anchors.reshape(count, length // 8, 8).transpose(1, 2, 0).astype(kind)
    tables = np.zeros((length // 8, 256, count), kind)
    for bit in range(8):
        tables[:, 1 << bit : 2 << bit] = tables[:, : 1 << bit] + grouped[:, bit : bit + 1]
    return tables


def look_up(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Scores (candidates, anchors): shift, and add what the tables hold for the bytes of each plane."""
    total = np.zeros((len(planes), tables.shape[2]), tables.dtype)
    top = planes.shape[1] - 1
    for plane in range(top, -1, -1):
        np.left_shift(total, 1, out=total)
        for group, table in enumerate(tables):
            read = table[planes[:, plane, group]]
            total = total - read if plane == top else np.add(total, read, out=total)
    return total


class _Best:
    """The best ``size`` candidates of each of ``count`` lists: higher scores first, ties by smaller id."""

    def __init__(self, count: int, size: int):
        self.size = size
        self.scores = np.zeros((count, size), np.int64)
        self.ids = np.zeros((count, size), np.int64)
        self.held = np.zeros((count, size), bool)

    def take(self, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """Offer a chunk: scores and flags (lists, candidates), ids in rising order."""
        places = len(ids)
        keys = np.where(allowed, scores.astype(np.int64) * places + np.arange(places)[::-1], np.iinfo(np.int64).min)
        if places > self.size:
            chosen = np.argpartition(keys, places - self.size, axis=1)[:, places - self.size :]
        else:
            chosen = np.broadcast_to(np.arange(places), keys.shape)
        pick = lambda values: np.take_along_axis(values, chosen, axis=1)
        found = np.concatenate([self.scores, pick(scores).astype(np.int64)], axis=1)
        owners = np.concatenate([self.ids, ids[chosen]], axis=1)
        held = np.concatenate([self.held, pick(allowed)], axis=1)
        order = np.lexsort((owners, -found, ~held), axis=1)[:, : self.size]
        self.scores, self.ids, self.held = (np.take_along_axis(x, order, axis=1) for x in (found, owners, held))

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.nonzero(self.held)
        return at[0], self.ids[at], self.scores[at]


def _pack(length: int, bits: int, factor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2)
            rows = np.flatnonzero(usable(vectors, length))
            values = np.floor(factor * matrix(vectors, rows, length))
            fits = (np.abs(values) < LARGEST).all(axis=1)
            rows, values = rows[fits], values[fits].astype(np.int64)
            taken = batch.take(pa.array(rows))
            planes = pack_planes(values, bits).reshape(len(rows), -1)
            yield pa.RecordBatch.from_arrays(
                [taken.column(0), taken.column(1), bytes_column(planes)], names=["id", "label", "planes"]
            )

    return run


def _planes(column: pa.Array, bits: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), bits, -1)


def _chunks(batches: Iterator[pa.RecordBatch], bits: int):
    """(ids, labels, planes) of at most CHUNK candidates, ids in rising order."""
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            part = batch.slice(at, CHUNK)
            ids = part.column(0).to_numpy()
            order = np.argsort(ids, kind="stable")
            yield ids[order], part.column(1).to_numpy()[order], _planes(part.column(2), bits)[order]


def _result(slots: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(ids), pa.array(scores)], names=["slot", "id", "score"])


def _positives(anchors: "Anchors", size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, best = anchors.tables(), _Best(len(anchors.ids), size)
        for ids, labels, planes in _chunks(batches, anchors.bits):
            allowed = (anchors.labels[:, None] == labels) & (anchors.ids[:, None] != ids)
            best.take(look_up(tables, planes).T, ids, allowed)
        yield _result(*best.rows())

    return run


def _negatives(anchors: "Anchors", own: np.ndarray, wanted: np.ndarray, size: int, low: int, high: int):
    """``own`` and ``wanted``: for each slot, the place of its anchor and the score of its positive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, best = anchors.tables(), _Best(len(own), size)
        for ids, labels, planes in _chunks(batches, anchors.bits):
            scores = look_up(tables, planes).T.astype(np.int64)[own]
            other = anchors.labels[own, None] != labels
            inside = (low * wanted[:, None] <= 100 * scores) & (100 * scores <= high * wanted[:, None])
            best.take(scores, ids, other & inside)
        yield _result(*best.rows())

    return run


class Anchors:
    """One block of anchors: what their tables are made of. The tables are made where they are used."""

    def __init__(self, rows, bits: int):
        self.ids = np.array([r["id"] for r in rows], np.int64)
        self.labels = np.array([r["label"] for r in rows], np.int64)
        self.planes = np.frombuffer(b"".join(r["planes"] for r in rows), np.uint8).reshape(len(rows), bits, -1)
        self.bits = bits

    def tables(self) -> np.ndarray:
        values = unpack_planes(self.planes)
        narrow = values.shape[1] << (2 * self.bits - 2) < 1 << 31
        return subset_sums(values, np.int32 if narrow else np.int64)


def _first(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """The best ``size`` rows of each list, numbered from 1."""
    ranked = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= size)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column | str = "label",
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    factor: float = 256.0,
    id_column: str = "vec_id",
    column: str = "embedding",
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Scores are inner products of ``floor(factor * component)``. An anchor's positives are its best
    ``positives`` other rows of the same label; for each, the best ``negatives`` rows of other
    labels with ``low <= 100 * negative / positive <= high`` are returned (multiplied out: for a
    positive below zero nothing lies between the limits). Higher scores come first, ties go by smaller id.

    Rows without id or label, with a null vector, a null or non-finite component, a scaled component of
    2^20 or more, or another length than most vectors take no part. Rows with equal ids are different
    candidates but never positives of each other; equal anchors count once, and each of several different
    rows with an anchor's id is an anchor. Other columns are not read. An empty table gives an empty one.

    A block of ``ANCHORS`` anchors is one reading of all candidates for the positives and one for the
    negatives; the driver holds the anchors and positives of one block at a time.
    """
    spark = vectors.sparkSession
    labelled = vectors.select(
        F.col(id_column).cast("bigint").alias("id"), (F.col(label) if isinstance(label, str) else label).cast("bigint").alias("label"),
        F.col(column).alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
    ).where("id IS NOT NULL AND label IS NOT NULL")
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    length = length_of(labelled, "vector")
    if not length:
        return spark.createDataFrame([], schema)
    largest = labelled.select(F.max(F.array_max(F.transform(
        F.filter("vector", lambda x: x.isNotNull() & (F.abs(x) < LARGEST / factor)), lambda x: F.abs(F.floor(factor * x.cast("double")))
    )))).first()[0]
    bits = int(largest or 0).bit_length() + 1
    packed = labelled.select("id", "label", "vector").mapInArrow(_pack(length, bits, factor), _PACKED)
    # planes are small and scoring is long, so they are dealt to all cores, not by the bytes of the files
    packed = stage(packed.repartition(2 * spark.sparkContext.defaultParallelism), "bit-planes")
    marked = labelled.where("anchor").select("id", "label", "vector").mapInArrow(_pack(length, bits, factor), _PACKED)
    anchors = stage(marked.distinct(), "anchors")
    blocks = math.ceil(anchors.count() / ANCHORS)
    parts = []
    for block in range(blocks):
        chosen = anchors.where(F.pmod(F.xxhash64("id", "label", "planes"), F.lit(blocks)) == block).orderBy("id", "label", "planes").collect()
        if not chosen:
            continue
        held = Anchors(chosen, bits)
        near = _first(packed.mapInArrow(_positives(held, positives), _SCORED), ["slot"], positives)
        pairs = near.orderBy("slot", "rank").collect()
        if not pairs:
            continue
        own, wanted = np.array([p["slot"] for p in pairs]), np.array([p["score"] for p in pairs], np.int64)
        scored = packed.mapInArrow(_negatives(held, own, wanted, negatives, low, high), _SCORED)
        names = spark.createDataFrame(
            [(i, int(held.ids[p["slot"]]), p["id"], p["score"]) for i, p in enumerate(pairs)],
            "slot int, anchor_id bigint, positive_id bigint, positive_score bigint",
        )
        best = _first(scored, ["slot"], negatives).join(F.broadcast(names), "slot")
        parts.append(stage(best.select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        ), "hard-negatives"))
    if not parts:
        return spark.createDataFrame([], schema)
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
