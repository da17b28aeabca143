"""Near-duplicates by a join inverted on signature coordinates.

1. Every text becomes its set of word shingles (64-bit hashes) and a MinHash signature. Texts with
   equal sets are one class from here on.
2. Each class is posted under its (coordinate, value) pairs. Values that only one class has can
   never collide and are dropped; two classes are a match if at least ``matches`` of their
   coordinates collide.
3. Prefix: a class orders its shared values from the rarest to the most frequent and merges only the
   lists of the first ``shared - matches + 1`` of them. A pair with enough collisions meets in
   at least one of these lists. Skip: the ``matches - 1`` longest lists of a class are never
   merged; pairs that met in a short list are looked up in them by comparing signatures.
4. Matches are confirmed on the full sets.

Long lists come from large groups of copies. Their pairs are not all made. Each list is first
tied to one class of it, and components are formed from the confirmed links. Lists that still hold
several components are merged in blocks: a task holds two blocks of a list with longer
signatures of one byte per coordinate, and only pairs from different components with enough collisions
leave it. So components are exactly those of all confirmed matches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from pricemill.llm.columns import free
from pricemill.llm.components import components
from pricemill.llm.spans import SpanHasher, mix, text_chunks, words
from pricemill.session import stage

SHINGLE = 5
# Coordinates under which classes are posted, and those of the longer signatures.
COORDINATES = 64
LONG_COORDINATES = 512
# Rows of a list that a task compares with as many others.
BLOCK = 4096

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_random = np.random.default_rng(20)
WORD_FACTORS = _random.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _family(size: int) -> tuple[np.ndarray, np.ndarray]:
    factors = _random.integers(1, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return factors[:, None], _random.integers(1, 1 << 63, size, dtype=np.uint64)[:, None]


SHORT, LONG = _family(COORDINATES), _family(LONG_COORDINATES)


def least_matches(percent: int, coordinates: int) -> int:
    """Collisions that a pair of this similarity has, but for a chance of a few in a million: five
    standard deviations below the mean."""
    p = percent / 100
    return math.floor(coordinates * p - 5 * math.sqrt(coordinates * p * (1 - p)))


def shingle_sets(column: pa.Array, hasher: SpanHasher) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a string column."""
    for _, data, offsets in text_chunks(column):
        lowered = LOWER[data]
        starts, ends, rows = words(lowered, offsets, IS_SPACE)
        hashes = hasher(lowered, starts, ends) if len(starts) else np.empty(0, np.uint64)
        bounds = np.searchsorted(rows, np.arange(len(offsets)))
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            own = hashes[low:high]
            n = len(own)
            if not n:
                yield own
                continue
            size = min(n, SHINGLE)
            sums = np.full(n - size + 1, size, np.uint64)
            for i in range(size):
                sums += own[i : n - size + 1 + i] * WORD_FACTORS[i]
            yield np.unique(mix(sums))


def _signature(shingles: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    factors, addends = family
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        part = shingles[None, at : at + 1024]
        np.minimum(least, ((part * factors + addends) >> np.uint64(32)).min(axis=1), out=least)
    return least.astype("<u4")


def _summaries(text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher()
        for batch in batches:
            sets = shingle_sets(batch.column(text_at), hasher)
            sizes, keys, signatures = [], [], []
            for own in sets:
                sizes.append(len(own))
                with np.errstate(over="ignore"):
                    halves = (int(own.sum(dtype=np.uint64)), int(mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)))
                keys.append(b"".join(h.to_bytes(8, "little") for h in (*halves, len(own))))
                signatures.append(_signature(own, SHORT).tobytes() if len(own) else None)
            rest = [c for i, c in enumerate(batch.columns) if i != text_at]
            names = [n for i, n in enumerate(batch.schema.names) if i != text_at]
            made = [pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary())]
            yield pa.RecordBatch.from_arrays([*rest, *made], names=[*names, "n_shingles", "_llm_set", "_llm_signature"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, shingles, long signature of one byte per coordinate)."""
    hasher = SpanHasher()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = list(shingle_sets(part.column(1), hasher))
            long = [_signature(own, LONG).astype(np.uint8).tobytes() for own in sets]
            made = [part.column(0), pa.array([own.tobytes() for own in sets], pa.binary()), pa.array(long, pa.binary())]
            yield pa.RecordBatch.from_arrays(made, names=["id", "shingles", "long"])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, signature) to (value, id): one row per coordinate."""
    places = np.arange(COORDINATES, dtype=np.int64) << 32
    for batch in batches:
        if not batch.num_rows:
            continue
        signatures = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(-1, COORDINATES)
        values = (signatures.astype(np.int64) + places).ravel()
        ids = np.repeat(batch.column(0).to_numpy(), COORDINATES)
        yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(ids)], names=["value", "id"])


def _matched(needed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(a, b, long signature of a, long signature of b) to the pairs with enough collisions."""
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, LONG_COORDINATES) for i in (2, 3))
            enough = pa.array((one == two).sum(axis=1) >= needed)
            yield batch.select(["a", "b"]).filter(enough)

    return run


INSIDE, OUTSIDE, OWN = range(3)


def _met_in_blocks(needed: int):
    """Rows (value, unit, id, part, role, long, values), sorted by value and unit, to pairs (a, b).

    Each row in the role ``OWN`` meets the unit's other rows of different parts. Pairs with enough
    collisions leave, each once: from the least value that both have, and of two rows outside the largest
    component only from that with the smaller id.
    """

    def pairs(rows: pa.Table) -> pa.RecordBatch | None:
        ids, parts, role = (rows.column(c).to_numpy() for c in ("id", "part", "role"))
        long = np.frombuffer(b"".join(rows.column("long").to_pylist()), np.uint8).reshape(-1, LONG_COORDINATES)
        lists = rows.column("values").to_pylist()
        width = max(map(len, lists))
        values = np.array([v + [-1] * (width - len(v)) for v in lists], np.int64)
        value = rows.column("value")[0].as_py()
        others = np.flatnonzero(role != OWN)
        a, b = [], []
        for i in np.flatnonzero(role == OWN):
            to = others[(parts[others] != parts[i]) & ((role[others] == INSIDE) | (ids[others] > ids[i]))]
            to = to[(long[to] == long[i]).sum(axis=1) >= needed]
            common = np.isin(values[to], lists[i])
            to = to[values[to, common.argmax(axis=1)] == value] if len(to) else to
            a.append(np.minimum(ids[to], ids[i]))
            b.append(np.maximum(ids[to], ids[i]))
        if not a:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # rows of a unit that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            rows = pa.concat_tables([waiting, table]) if waiting is not None else table
            value, unit = rows.column("value").to_numpy(), rows.column("unit").to_numpy()
            edges = np.flatnonzero((value[1:] != value[:-1]) | (unit[1:] != unit[:-1])) + 1
            starts = [0, *edges.tolist()]
            for low, high in zip(starts[:-1], starts[1:], strict=True):
                if (made := pairs(rows.slice(low, high - low))) is not None:
                    yield made
            waiting = rows.slice(starts[-1])
        if waiting is not None and (made := pairs(waiting)) is not None:
            yield made

    return run


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(a, b, shingles of a, shingles of b) to the pairs that are similar enough."""
        for batch in batches:
            verdict = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                one, two = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                small, large = sorted((one, two), key=len)
                at = np.searchsorted(large, small)
                common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                verdict.append(100 * common >= percent * (len(one) + len(two) - common))
            yield batch.select(["a", "b"]).filter(pa.array(verdict, pa.bool_()))

    return run


def _prefix_lists(classes: DataFrame, needed: int) -> DataFrame:
    """(value, id) of the short lists that each class merges."""
    posted = classes.select("id", "_llm_signature").mapInArrow(_postings, "value bigint, id bigint")
    shared = posted.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    own = posted.join(shared, "value").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "value"))).alias("own"))
    rare = F.slice("own", 1, F.size("own") - (needed - 1))
    return own.where(F.size("own") >= needed).select("id", F.explode(rare).alias("v")).select(F.col("v.value"), "id")


def _with(pairs: DataFrame, sets: DataFrame, value: str) -> DataFrame:
    """Pairs (a, b) with a column of both classes."""
    side = lambda name, as_: sets.select(F.col("id").alias(name), F.col(value).alias(as_))
    return pairs.join(side("a", "sa"), "a").join(side("b", "sb"), "b").select("a", "b", "sa", "sb")


def _collide(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    needed = least_matches(percent, LONG_COORDINATES)
    return _with(pairs, sets, "long").mapInArrow(_matched(needed), "a bigint, b bigint")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    met = stage(pairs.distinct(), "matches")
    return stage(_with(met, sets, "shingles").mapInArrow(_confirmed(percent), "a bigint, b bigint"), "confirmed")


def _tied(lists: DataFrame) -> DataFrame:
    """Pairs of each class with the least class of its list."""
    hubs = lists.groupBy("value").agg(F.min("id").alias("hub"))
    return lists.join(hubs, "value").where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()


def _across(lists: DataFrame, parts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with enough collisions from lists that hold several components.

    At least one of such a pair lies outside the list's largest component, so those rows alone meet
    the others. Both are dealt into blocks, and each pair of blocks is a unit of work.
    """
    placed = lists.join(parts.withColumnRenamed("node", "id"), "id", "left")
    placed = stage(placed.select("value", "id", F.coalesce("component", "id").alias("part")), "lists")
    sizes = placed.groupBy("value", "part").agg(F.count(F.lit(1)).alias("n"))
    open_ = sizes.groupBy("value").agg(
        F.max_by("part", F.struct("n", "part")).alias("largest"), F.sum("n").alias("all"), F.max("n").alias("most")
    ).where("all > most")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    dealt = placed.join(open_, "value").withColumns(
        {"wide": blocks(F.col("all")), "high": blocks(F.col("all") - F.col("most")), "h": F.xxhash64("id")}
    )
    at = lambda n: F.pmod(F.col("h"), F.col(n)).cast("int")
    outside = F.col("part") != F.col("largest")
    spread = lambda role, unit: F.struct(role.alias("role"), unit.cast("int").alias("unit"))
    role = F.when(outside, OUTSIDE).otherwise(INSIDE)
    as_other = F.transform(F.sequence(F.lit(0), F.col("high") - 1), lambda i: spread(role, i * F.col("wide") + at("wide")))
    as_own = F.transform(F.sequence(F.lit(0), F.col("wide") - 1), lambda j: spread(F.lit(OWN), at("high") * F.col("wide") + j))
    both = F.when(outside, F.concat(as_other, as_own)).otherwise(as_other)
    units = dealt.select("value", "id", "part", F.explode(both).alias("u")).select("value", "u.unit", "id", "part", "u.role")
    values = lists.groupBy("id").agg(F.array_sort(F.collect_list("value")).alias("values"))
    filled = units.join(sets.select("id", "long"), "id").join(values, "id")
    filled = filled.select("value", "unit", "id", "part", "role", "long", "values")
    sorted_ = filled.repartition("value", "unit").sortWithinPartitions("value", "unit")
    return sorted_.mapInArrow(_met_in_blocks(least_matches(percent, LONG_COORDINATES)), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns but the text, and ``n_shingles``, ``component_id`` and ``kept`` (the id is its component's).

    Words are separated by ASCII white space, A-Z count as a-z. A text of fewer than five words has
    one shingle of all its words; one without words (null, empty) has none and is linked with
    nothing. Texts are linked if ``100 * common >= percent * union``. ``component_id`` is the
    smallest id reachable by links. Rows without an id are linked with nothing and kept, with a null
    component. Of rows with one id and different texts each follows the links of its own text.
    """
    spark = docs.sparkSession
    docs = free(docs, "n_shingles", "component_id", "kept")
    made = spark.createDataFrame([], "n_shingles bigint, _llm_set binary, _llm_signature binary").schema
    rest = [f for f in docs.schema.fields if f.name != text]
    summaries = stage(docs.mapInArrow(_summaries(docs.columns.index(text)), T.StructType([*rest, *made.fields])), "shingle-summaries")
    linkable = F.col(key).isNotNull() & (F.col("n_shingles") > 0)
    classes = stage(
        summaries.where(linkable).groupBy("_llm_set")
        .agg(F.min(F.col(key).cast("bigint")).alias("id"), F.first("_llm_signature").alias("_llm_signature")),
        "classes",
    )
    lists = stage(_prefix_lists(classes, least_matches(percent, COORDINATES)), "lists")
    chosen = stage(lists.select("id").distinct(), "listed")
    texts = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("_llm_text"))
    sets = stage(
        texts.join(chosen, "id", "left_semi").mapInArrow(_sets, "id bigint, shingles binary, long binary").distinct(),
        "shingle-sets",
    )
    links = _confirm(_collide(_tied(lists), sets, percent), sets, percent)
    more = _confirm(_across(lists, components(links), sets, percent), sets, percent)
    parts = components(links.unionByName(more))
    named = classes.join(parts.withColumnRenamed("node", "id"), "id", "left").select(
        F.col("_llm_set").alias("_llm_class"), F.coalesce("component", "id").alias("_llm_component")
    )
    joined = summaries.join(named, linkable & (F.col("_llm_set") == F.col("_llm_class")), "left")
    component = F.when(F.col(key).isNotNull(), F.coalesce("_llm_component", F.col(key).cast("bigint")))
    return (
        joined.withColumns({"component_id": component, "kept": F.coalesce(F.col(key) == component, F.lit(True))})
        .drop("_llm_set", "_llm_signature", "_llm_class", "_llm_component")
    )


def drop_near_duplicates(docs: DataFrame, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, the one with the smallest id.

    Rows without an id stay.
    """
    judged = near_duplicates(docs.select(key, text), percent, key, text)
    gone = judged.where("not kept").select(F.col(key).alias("_llm_gone"))
    return docs.join(gone, F.col(key) == F.col("_llm_gone"), "left_anti")
