"""Line deduplication that can be undone: sharded cuckoo filters over exact reference counts.

A line's key is the MD5 of the stripped, lower-cased line. The exact tables say which documents hold
a key (``holders``) and how many do (``counts``). In front of them stands one cuckoo filter per
shard of keys: a batch of new documents asks the filters first, and only keys that a filter may know
are looked up and merged with their exact counts; all others are new for certain and are appended.
Deleting documents lowers the counts; keys that nobody holds any more are removed from the filters,
which cuckoo filters allow and Bloom filters do not. No table is written again: a change appends the
rows of the keys it touches under its own number, and of a key's rows the last one counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pricemill.llm.columns import free
from pricemill.session import stage

# What is stripped from both ends of a line, and the letters that are lower-cased.
SPACES = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_CHARS = 10

# Keys a shard should hold at most when the index is made; more only make its filter larger.
SHARD_KEYS = 50_000
MIN_SHARDS = 64
SLOTS, LOAD, MAX_KICKS = 4, 0.85, 64

KEY_ROW = "shard int, key binary, refs bigint, first_doc bigint, known boolean"
FILTER_ROW = "shard int, buckets bigint, slots binary"


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; whole arrays of keys are added, asked and removed at once."""

    def __init__(self, buckets: int, slots: bytes | None = None):
        self.buckets = buckets
        flat = np.zeros(buckets * SLOTS, np.uint16) if slots is None else np.frombuffer(slots, np.uint16).copy()
        self.table = flat.reshape(buckets, SLOTS)

    @classmethod
    def for_keys(cls, n: int) -> CuckooFilter:
        wanted = max(4, int(n / (SLOTS * LOAD)) + 1)
        return cls(1 << (wanted - 1).bit_length())

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and both buckets of 16-byte keys given as two unsigned 64-bit columns."""
        prints = (keys[:, 1] & np.uint64(0xFFFF)).astype(np.uint16)
        prints[prints == 0] = 1
        one = (keys[:, 0] & np.uint64(self.buckets - 1)).astype(np.int64)
        return prints, one, self._other(one, prints)

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return bucket ^ ((prints.astype(np.int64) * 0x5BD1E995 >> 7) & (self.buckets - 1))

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, one, two = self._places(keys)
        same = lambda at: (self.table[at] == prints[:, None]).any(axis=1)
        return same(one) | same(two)

    def add(self, keys: np.ndarray) -> bool:
        """Add distinct keys; False if the table is too full, and then it must be rebuilt larger."""
        prints, at, _ = self._places(keys)
        rng = np.random.default_rng(len(keys))
        for _ in range(MAX_KICKS):
            for _ in range(2):  # into free slots of one bucket, then of the other
                for slot in range(SLOTS):
                    free = self.table[at, slot] == 0
                    _, chosen = np.unique(at[free], return_index=True)
                    taken = np.flatnonzero(free)[chosen]
                    self.table[at[taken], slot] = prints[taken]
                    left = np.ones(len(at), bool)
                    left[taken] = False
                    at, prints = at[left], prints[left]
                at = self._other(at, prints)
            if not len(at):
                return True
            # evict: one waiting print per bucket changes place with a random slot of it
            _, chosen = np.unique(at, return_index=True)
            slot = rng.integers(0, SLOTS, len(chosen))
            moved = self.table[at[chosen], slot].copy()
            self.table[at[chosen], slot] = prints[chosen]
            prints[chosen] = moved
            at[chosen] = self._other(at[chosen], moved)
        return False

    def remove(self, keys: np.ndarray) -> None:
        """Remove keys that were added before."""
        for print_, one, two in zip(*self._places(keys), strict=True):
            for at in (one, two):
                found = np.flatnonzero(self.table[at] == print_)
                if len(found):
                    self.table[at, found[0]] = 0
                    break


@dataclass
class LineIndex:
    """``holders`` (shard, key, doc_id, version), ``counts`` (shard, key, refs, first_doc, version), ``filters``
    (shard, buckets, slots), ``deleted`` (doc_id, version) or None, and the number of changes so far."""

    holders: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    deleted: DataFrame | None = None
    version: int = 0

    def live_holders(self) -> DataFrame:
        """(shard, key, doc_id) of documents that were not deleted after they came in."""
        if self.deleted is None:
            return self.holders.drop("version")
        gone = self.deleted.select(F.col("doc_id").alias("_gone"), F.col("version").alias("_at"))
        later = (F.col("doc_id") == F.col("_gone")) & (F.col("version") < F.col("_at"))
        return self.holders.join(gone, later, "left_anti").drop("version")

    def live_counts(self, least: int = 1) -> DataFrame:
        """(shard, key, refs, first_doc) of keys that at least ``least`` documents hold."""
        enough = F.col("refs") >= least
        rows = self.counts
        if self.deleted is None:  # counts have only grown, so a key's last row is its largest
            rows = rows.where(enough)
        if self.version > 1:
            last = F.max_by(F.struct("refs", "first_doc"), "version").alias("_last")
            rows = rows.groupBy("shard", "key").agg(last).select("shard", "key", "_last.*")
        return rows.where(enough).select("shard", "key", "refs", "first_doc")


def _halves(keys: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(keys), dtype=np.uint64).reshape(-1, 2) if len(keys) else np.empty((0, 2), np.uint64)


def _normal(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, UPPER.lower())


def line_keys(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, key) for every different line of a document that has at least ``min_chars`` code points.

    Rows without an id hold nothing; rows of one id are one document.
    """
    lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), _normal)
    long = F.array_distinct(F.filter(lines, lambda line: F.char_length(line) >= min_chars))
    named = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("doc_id"), F.explode(long).alias("line"))
    return named.select("doc_id", F.unhex(F.md5("line")).alias("key"))


def _counted(holders: DataFrame) -> DataFrame:
    return holders.groupBy("shard", "key").agg(F.count(F.lit(1)).alias("refs"), F.min("doc_id").alias("first_doc"))


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard")


def empty_index(spark: SparkSession, shards: int) -> LineIndex:
    """An index without documents."""
    make = lambda schema: spark.createDataFrame([], schema)
    return LineIndex(
        make("shard int, key binary, doc_id bigint, version int"),
        make("shard int, key binary, refs bigint, first_doc bigint, version int"),
        make(FILTER_ROW), shards,
    )


def _ask(batch: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    """Mark the batch's keys that the shard's filter may know."""
    known = np.zeros(len(batch), bool)
    if len(filters) and len(batch):
        known = CuckooFilter(int(filters["buckets"][0]), filters["slots"][0]).contains(_halves(batch["key"]))
    return batch.assign(known=known)


def _build(counts: pd.DataFrame) -> pd.DataFrame:
    """The filter over a shard's keys; doubled until all of them fit."""
    keys = _halves(counts["key"])
    made = CuckooFilter.for_keys(len(keys))
    while not made.add(keys):
        made = CuckooFilter(made.buckets * 2)
    return pd.DataFrame({"shard": [int(counts["shard"].iloc[0])], "buckets": [made.buckets], "slots": [made.table.tobytes()]})


def _enter(new: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    """Put new keys into the shard's filter; slots None asks for a rebuild from the exact table."""
    if not len(new):
        return filters[["shard", "buckets", "slots"]]
    if not len(filters):
        return _build(new)
    grown = CuckooFilter(int(filters["buckets"][0]), filters["slots"][0])
    fits = grown.add(_halves(new["key"]))
    return filters[["shard", "buckets"]].assign(slots=[grown.table.tobytes() if fits else None])


def _leave(gone: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    """Take keys out of the shard's filter."""
    if not len(filters) or not len(gone):
        return filters[["shard", "buckets", "slots"]]
    less = CuckooFilter(int(filters["buckets"][0]), filters["slots"][0])
    less.remove(_halves(gone["key"]))
    return filters[["shard", "buckets"]].assign(slots=[less.table.tobytes()])


def _per_shard(left: DataFrame, filters: DataFrame, function, schema: str) -> DataFrame:
    return left.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(function, schema)


def ask(index: LineIndex, holders: DataFrame) -> DataFrame:
    """(shard, key, refs, first_doc, known) of a batch's (shard, key, doc_id): the keys that a filter may know are marked."""
    return _per_shard(_counted(holders), index.filters, _ask, KEY_ROW)


def insert(index: LineIndex, holders: DataFrame) -> LineIndex:
    """Add the (doc_id, key) rows of new documents, as :func:`line_keys` gives them.

    Documents must not be in the index. Of a batch's keys, those the filters may know are merged
    with their exact counts; the others are appended without looking anything up.
    """
    version = index.version + 1
    numbered = lambda rows: rows.withColumn("version", F.lit(version))
    batch = stage(numbered(holders.select(_shard(index.shards), "key", "doc_id").distinct()), "line-holders")
    asked = stage(ask(index, batch.drop("version")), "line-batch")
    before = index.live_counts().withColumnsRenamed({"refs": "old_refs", "first_doc": "old_first"})
    known = asked.where("known").join(before, ["shard", "key"], "left").select(
        "shard", "key", (F.col("refs") + F.coalesce("old_refs", F.lit(0))).alias("refs"),
        F.least("first_doc", "old_first").alias("first_doc"), F.col("old_refs").isNull().alias("mistaken"),
    )
    known = stage(known, "line-known")
    new = asked.where("not known").select("shard", "key", "refs", "first_doc")
    counts = index.counts.unionByName(numbered(new.unionByName(known.drop("mistaken"))))
    # the filter errs for a few keys: it may know them, but the exact table does not
    entering = new.select("shard", "key").unionByName(known.where("mistaken").select("shard", "key"))
    filters = stage(_per_shard(entering, index.filters, _enter, FILTER_ROW), "line-filters")
    grown = LineIndex(index.holders.unionByName(batch), counts, filters, index.shards, index.deleted, version)
    full = filters.where("slots is null").select("shard")
    rebuilt = grown.live_counts().join(full, "shard", "left_semi").groupBy("shard").applyInPandas(_build, FILTER_ROW)
    return replace(grown, filters=filters.where("slots is not null").unionByName(rebuilt))


def delete(index: LineIndex, doc_ids: DataFrame) -> LineIndex:
    """Take documents (a column ``doc_id``) out again; unknown ids change nothing.

    Only the keys that these documents held are counted again. Documents may be inserted anew later.
    """
    version = index.version + 1
    numbered = lambda rows: rows.withColumn("version", F.lit(version))
    ids = stage(numbered(doc_ids.select(F.col("doc_id").cast("bigint")).distinct()), "line-deleted")
    touched = stage(index.live_holders().join(ids, "doc_id", "left_semi").select("shard", "key").distinct(), "line-touched")
    deleted = ids if index.deleted is None else index.deleted.unionByName(ids)
    less = replace(index, deleted=deleted, version=version)
    left = _counted(less.live_holders().join(touched, ["shard", "key"], "left_semi"))
    again = touched.join(left, ["shard", "key"], "left").select("shard", "key", F.coalesce("refs", F.lit(0)).alias("refs"), "first_doc")
    again = stage(numbered(again), "line-counts")
    gone = again.where("refs = 0").select("shard", "key")
    filters = stage(_per_shard(gone, index.filters, _leave, FILTER_ROW), "line-filters")
    return replace(less, counts=index.counts.unionByName(again), filters=filters)


def build_index(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, batches: int = 1
) -> LineIndex:
    """An index of all ``docs``, with as many shards as their lines need, inserted in ``batches`` parts.

    A document's id decides its part. From the second part on, filters keep most keys away from the exact counts.
    """
    holders = stage(line_keys(docs, key, text, min_chars), "line-keys")
    index = empty_index(docs.sparkSession, max(MIN_SHARDS, -(-holders.count() // SHARD_KEYS)))
    part = F.pmod(F.xxhash64("doc_id", F.lit(batches)), F.lit(batches))
    for number in range(batches):
        index = insert(index, holders.where(part == number) if batches > 1 else holders)
    return index


def _without(text_at: int, drops_at: int, min_chars: int):
    lower = str.maketrans(UPPER, UPPER.lower())

    def keep(text: str | None, drops: list[bytes] | None) -> tuple[str, int, int]:
        lines = (text or "").split("\n")
        if not drops:
            return "\n".join(lines), len(lines), 0
        gone = set(drops)
        kept = []
        for line in lines:
            normal = line.strip(SPACES).translate(lower)
            if len(normal) < min_chars or hashlib.md5(normal.encode()).digest() not in gone:
                kept.append(line)
        return "\n".join(kept), len(lines), len(lines) - len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [keep(t.as_py(), d.as_py()) for t, d in zip(batch.column(text_at), batch.column(drops_at), strict=True)]
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))]
            columns = [c for i, c in enumerate(batch.columns) if i != drops_at]
            names = [n for i, n in enumerate(batch.schema.names) if i != drops_at]
            yield pa.RecordBatch.from_arrays([*columns, *made], names=[*names, "kept_text", "n_lines", "n_dropped"])

    return run


def drop_repeated_lines(
    docs: DataFrame, index: LineIndex, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS
) -> DataFrame:
    """Append ``kept_text``, ``n_lines`` and ``n_dropped``.

    A line held by at least two documents of the index stays only in the smallest ``doc_id`` that
    holds it, there with all its repetitions. Rows without an id keep all lines. A document that
    loses all lines gets an empty text.
    """
    docs = free(docs, "kept_text", "n_lines", "n_dropped")
    repeated = index.live_counts(least=2).select("shard", "key", "first_doc")
    drops = (
        index.live_holders().join(repeated, ["shard", "key"]).where("doc_id <> first_doc")
        .groupBy(F.col("doc_id").alias("_llm_doc")).agg(F.collect_set("key").alias("_llm_drops"))
    )
    joined = docs.join(drops, F.col(key).cast("bigint") == F.col("_llm_doc"), "left").drop("_llm_doc")
    schema = docs.limit(0).selectExpr("*", "'' as kept_text", "0L as n_lines", "0L as n_dropped").schema
    return joined.mapInArrow(_without(docs.columns.index(text), len(docs.columns), min_chars), schema)
