"""Near-duplicate vectors by randomly rotated binary codes with correction factors.

1. Equal vectors of a label are one class; its representative has the smallest id.
2. A representative ``o`` of length 1 is turned by a random rotation and padded to more dimensions; the
   signs are its code. The code stands for the unit vector ``x`` with entries ``+-1/sqrt(bits)``, and the
   stored correction factor is ``c = <x, o>``. For a rotated vector ``q``, ``<x, q> / c`` is an unbiased
   estimate of ``<o, q>``. If that product is ``s``, the error has the deviation
   ``sqrt(1 - s^2) * sqrt(1 - c^2) / (c * sqrt(bits - 1))``.
3. Representatives meet in lists: the code is cut into bands, and a list holds those of a label that agree in all bits of a band.
   A pair at the threshold agrees in a bit with the chance ``1 - angle/pi``; there are as many bands as make the
   chance that it agrees in none of them less than ``MISS``. Bands are so wide that a list has about ``LIST`` rows.
4. In a list every pair gets its estimate. Pairs whose upper bound (``DEVIATIONS`` deviations) stays below the threshold are
   done; the exact cosine decides the others. A pair that met in an earlier band is left to that band.

No pair leaves a task: a list gives, for each member, the number of rows that it links with and
the smallest id of its own component in the list. Lists longer than ``BLOCK`` are dealt into parts,
and a task compares two parts.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T

from pricemill.llm.columns import free
from pricemill.llm.components import components
from pricemill.llm.vectors import bytes_column, length_of, matrix, usable
from pricemill.session import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The chance that a pair exactly at the threshold shares no list, and the deviations that its estimate may be off.
MISS = 1e-6
DEVIATIONS = 6.0
# Bits that an estimate needs at least, wanted rows of a list, and rows of a list that a task compares with as many others.
LEAST_BITS = 128
LIST = 1024
BLOCK = 2048
# Pairs whose exact cosines are computed at a time.
EXACT = 16384

_POSTED = "key binary, id bigint, label int, weight bigint, vector binary, factor float, code binary, band int, value bigint"
_FOUND = "key binary, links bigint, least binary"


def bands_of(rows: int, threshold: float) -> tuple[int, int]:
    """(bits, bands) for lists of about LIST of ``rows`` rows and a pair at the threshold missed with a chance below MISS."""
    bits = max(0, math.ceil(math.log2(max(1, rows) / LIST)))
    met = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, 1 if met == 1 else math.ceil(math.log(MISS) / math.log1p(-met))


def rotation(length: int, bits: int, seed: int) -> np.ndarray:
    """``length`` orthonormal columns of ``bits`` entries: a random rotation of vectors padded with zeros."""
    made, triangle = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, length)))
    return made * np.sign(np.diag(triangle))


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs (rows, bits) as flags, and the correction factors, of rows of length 1."""
    turned = unit @ turn.T
    return turned >= 0, np.abs(turned).sum(axis=1) / math.sqrt(len(turn))


def estimates(signs: np.ndarray, factors: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """Unbiased estimates of the inner products of coded rows with rotated rows."""
    x = np.where(signs, np.float32(1), np.float32(-1)) / np.float32(math.sqrt(signs.shape[1]))
    return (x @ turned.T.astype(np.float32)) / factors[:, None].astype(np.float32)


def deviations(factors: np.ndarray, bits: int, threshold: float) -> np.ndarray:
    """The deviation of the estimate of a pair at the threshold, for each coded row."""
    return math.sqrt(1 - threshold**2) * np.sqrt(np.maximum(0, 1 - factors**2)) / (factors * math.sqrt(bits - 1))


def _keys(length: int, id_at: int, vector_at: int, label_at: int):
    """The rows, and what makes vectors of a label equal: a digest, null where a row links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, labels = batch.column(vector_at), batch.column(label_at).to_pylist()
            known = batch.column(id_at).is_valid().to_numpy(zero_copy_only=False) & batch.column(label_at).is_valid().to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(usable(vectors, length) & known)
            values = np.ascontiguousarray(matrix(vectors, rows, length) + 0.0)  # no negative zeros
            keys = [None] * batch.num_rows
            for row, value in zip(rows.tolist(), values, strict=True):
                if value.any():
                    keys[row] = hashlib.blake2b(b"%d:" % labels[row] + value.tobytes(), digest_size=16).digest()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=[*batch.schema.names, "_llm_key"])

    return run


def _lengthened(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, safe for very small and very large entries."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _post(turn: np.ndarray, bits: int, bands: int):
    """Representatives with code and factor, once for each band; vectors in the width that they have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.left_shift(1, np.arange(bits, dtype=np.int64))
        for batch in batches:
            if not batch.num_rows:
                continue
            *rest, vectors = batch.columns
            kind = np.float32 if vectors.type.value_type == pa.float32() else np.float64
            values = matrix(vectors, np.arange(batch.num_rows), turn.shape[1])
            signs, factors = encode(_lengthened(values), turn)
            code = bytes_column(np.packbits(signs, axis=1, bitorder="little"))
            raw = bytes_column(values.astype(kind))
            for band in range(bands):
                value = signs[:, band * bits : (band + 1) * bits] @ weights
                yield pa.RecordBatch.from_arrays(
                    [*rest, raw, pa.array(factors, pa.float32()), code,
                     pa.array(np.full(batch.num_rows, band, np.int32)), pa.array(value.astype(np.int64))],
                    names=["key", "id", "label", "weight", "vector", "factor", "code", "band", "value"],
                )

    return run


def _tied(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each place the smallest place that links lead to."""
    least = np.arange(count)
    while True:
        before = least.copy()
        np.minimum.at(least, a, least[b])
        np.minimum.at(least, b, least[a])
        least = least[least]
        if (least == before).all():
            return least


def compared(vectors, factors, signs, first, second, turn, bits, band, threshold):
    """Linked pairs (i, j), each once, of places ``first`` and ``second`` that meet in no band before ``band``."""
    itself = first is second
    unit = _lengthened(vectors)
    turned = unit @ turn.T
    floor = threshold - DEVIATIONS * deviations(factors.astype(np.float64), len(turn), threshold)
    cut = signs[:, : band * bits].reshape(len(signs), band, bits)
    earlier = cut @ np.left_shift(1, np.arange(bits, dtype=np.int64)) if band else np.zeros((len(signs), 0))
    found = []
    step = max(1, EXACT * 64 // max(1, len(second)))
    for at in range(0, len(first), step):
        rows = first[at : at + step]
        open_ = estimates(signs[rows], factors[rows], turned[second]) >= floor[rows, None]
        i, j = np.nonzero(open_)
        i, j = rows[i], second[j]
        for part in range(0, len(i), EXACT):
            a, b = i[part : part + EXACT], j[part : part + EXACT]
            apart = (a < b if itself else True) & ~(earlier[a] == earlier[b]).any(axis=1)
            a, b = a[apart], b[apart]
            linked = np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold
            found.append((a[linked], b[linked]))
    if not found:
        return np.empty(0, int), np.empty(0, int)
    # of a pair within one part only one direction is estimated
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _link(turn: np.ndarray, bits: int, threshold: float, wide: bool):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, band, _, one, other = (k.as_py() for k in key)
        table = table.sort_by([("id", "ascending"), ("key", "ascending")])
        count, keys = table.num_rows, table["key"].to_pylist()
        read = lambda name, kind: np.frombuffer(b"".join(table[name].to_pylist()), kind).reshape(count, -1)
        vectors = read("vector", np.float64 if wide else np.float32).astype(np.float64)
        signs = np.unpackbits(read("code", np.uint8), axis=1, count=len(turn), bitorder="little").astype(bool)
        part, weights = table["part"].to_numpy(), table["weight"].to_numpy()
        first = np.flatnonzero(part == one)
        second = first if one == other else np.flatnonzero(part == other)
        a, b = compared(vectors, table["factor"].to_numpy(), signs, first, second, turn, bits, band, threshold)
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
        links = np.zeros(count, np.int64)
        np.add.at(links, a, weights[b])
        least, rows = _tied(count, a, b), np.flatnonzero(links)
        return pa.table({
            "key": pa.array([keys[r] for r in rows], pa.binary()), "links": pa.array(links[rows]),
            "least": pa.array([keys[r] for r in least[rows]], pa.binary()),
        })

    return run


def near_duplicate_vectors(
    vectors: DataFrame, threshold: float = 0.93, id_column: str = "vec_id", column: str = "embedding", label: str = "label", seed: int = 11
) -> DataFrame:
    """``vectors`` with ``n_links``, ``component_id`` and ``kept``.

    Two rows link if their labels are equal and not null and the cosine of their vectors, in double precision, is at
    least ``threshold``. ``n_links`` counts the other rows that a row links with, ``component_id`` is the smallest id
    that links lead to, and ``kept`` marks the rows with that id. A pair at the threshold is missed with a chance
    below ``MISS``, a closer one with a far smaller chance; no pair below the threshold links.

    A row without id or label, with a null or zero vector, with a null or non-finite component or of another length than
    most links with nothing: it is its own component (null without id) and kept. Rows with equal ids link as others do.
    Columns with the name of a result column are replaced, others stay. An empty table gives an empty one.
    """
    rows = free(vectors, "n_links", "component_id", "kept")
    length = length_of(rows, column)
    at = [rows.columns.index(c) for c in (id_column, column, label)]
    schema = T.StructType([*rows.schema.fields, T.StructField("_llm_key", T.BinaryType())])
    keyed = stage(rows.mapInArrow(_keys(length, *at), schema), "vector-keys")
    classes = stage(
        keyed.where("_llm_key IS NOT NULL").groupBy(F.col("_llm_key").alias("key")).agg(
            F.min(F.col(id_column).cast("bigint")).alias("id"), F.first(F.col(label).cast("int")).alias("label"),
            F.count(F.lit(1)).alias("weight"), F.first(column).alias("vector"),
        ), "vector-classes",
    )
    found = _links(classes, length, threshold, seed)
    counts = found.groupBy("key").agg(F.sum("links").alias("links"))
    reached = components(found.select(F.col("key").alias("a"), F.col("least").alias("b"))).withColumnRenamed("node", "key")
    tied = stage(
        classes.select("key", "id", "weight").join(counts, "key", "left").join(reached, "key", "left")
        .withColumn("component", F.coalesce("component", "key")), "vector-components",
    )
    least = tied.groupBy("component").agg(F.min("id").alias("component_id"))
    own = tied.join(least, "component").select(
        F.col("key").alias("_llm_key"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"
    )
    whole = keyed.join(own, "_llm_key", "left").withColumns({
        "n_links": F.coalesce("n_links", F.lit(0)), "component_id": F.coalesce("component_id", F.col(id_column).cast("bigint")),
    })
    kept = F.coalesce(F.col("component_id") == F.col(id_column), F.lit(True))
    return whole.select(*rows.columns, "n_links", "component_id", kept.alias("kept"))


def _links(classes: DataFrame, length: int, threshold: float, seed: int) -> DataFrame:
    """``(key, links, least)`` of each list that a class has links in."""
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, bands = bands_of(largest, threshold)
    turn = rotation(max(1, length), max(LEAST_BITS, length, bits * bands), seed)
    posted = classes.select("key", "id", "label", "weight", "vector").mapInArrow(_post(turn, bits, bands), _POSTED)
    places = ["label", "band", "value"]
    long = stage(posted.groupBy(*places).count().where(F.col("count") > BLOCK), "long-lists")
    dealt = posted.join(long, places, "left")
    parts = F.ceil(F.coalesce(F.col("count"), F.lit(1)) / F.lit(BLOCK)).cast("int")
    dealt = dealt.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    # each part meets itself and every other one
    met = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.withColumns({"one": F.least("part", "with"), "other": F.greatest("part", "with")}).drop("count", "parts", "with")
    wide = dict(classes.dtypes)["vector"] == "array<double>"
    return stage(met.groupBy(*places, "one", "other").applyInArrow(_link(turn, bits, threshold, wide), _FOUND), "vector-links")
