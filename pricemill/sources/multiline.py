"""Delimited files whose quoted fields hold line breaks, read by many tasks a file.

Whether a line begins a record depends on all text before it, but only by one bit: is a quoted field open?
A first pass tells for every byte block (a split of the scan) how it ends if it begins closed and if it
begins open; following these along a file, one small row for each block, gives the bit each block begins
with. A second pass puts lines together inside their block, and only the records that cross a border of
blocks, at most one a border, are joined from pieces. Every record is then parsed by the built-in parser.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pricemill.session import stage

BLOCK_ROW = "file string, block bigint, closed_ends_open boolean, open_ends_open boolean, open_closes boolean"
START_ROW = "file string, block bigint, begins_open boolean, owner bigint"
RECORD_ROW = "file string, owner bigint, block bigint, whole boolean, first boolean, record string"


def ends_open(line: str, is_open: bool, separator: str, quote: str) -> bool:
    """Whether a quoted field is open behind ``line``, given whether one is open before it.

    A field is quoted if it begins with the quote; a doubled quote is part of it, a single one ends it,
    and what follows up to the separator is not quoted. Quotes inside other fields mean nothing.
    """
    at = 0
    while True:
        if not is_open and line.startswith(quote, at):
            is_open, at = True, at + 1
        while is_open:
            at = line.find(quote, at) + 1
            if not at:
                return True
            if line.startswith(quote, at):
                at += 1
            else:
                is_open = False
        at = line.find(separator, at) + 1
        if not at:
            return False


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 2000, most_characters: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in Arrow batches, bounded by their number and by the characters of their last column."""
    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    held, characters = [], 0
    for row in rows:
        held.append(row)
        characters += len(row[-1]) if isinstance(row[-1], str) else 0
        if len(held) >= most or characters >= most_characters:
            yield made()
            held, characters = [], 0
    if held:
        yield made()


def _block_ends(separator: str, quote: str):
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), *[(n, pa.bool_()) for n in ("closed", "open", "closes")]])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        at, closed, opened, closes = None, False, True, False
        for file, block, line in _rows(batches):
            if (file, block) != at:
                if at is not None:
                    yield *at, closed, opened, closes
                at, closed, opened, closes = (file, block), False, True, False
            if quote in line:
                closed = ends_open(line, closed, separator, quote)
                opened = ends_open(line, opened, separator, quote)
                closes = closes or not opened
        if at is not None:
            yield *at, closed, opened, closes

    return lambda batches: _batches(ends(batches), schema)


def _begins(blocks: pd.DataFrame) -> pd.DataFrame:
    """Follow the blocks of one file: how each begins, and in which block the record open there began."""
    is_open, owner, made = False, None, []
    for row in blocks.sort_values("block").itertuples():
        made.append((row.file, row.block, is_open, owner))
        if not (row.open_ends_open if is_open else row.closed_ends_open):
            is_open, owner = False, None
        else:
            owner = owner if is_open and not row.open_closes else row.block
            is_open = True
    frame = pd.DataFrame(made, columns=["file", "block", "begins_open", "owner"])
    return frame.astype({"owner": "Int64"})


def _records(separator: str, quote: str):
    schema = pa.schema([
        ("file", pa.string()), ("owner", pa.int64()), ("block", pa.int64()), ("whole", pa.bool_()),
        ("first", pa.bool_()), ("record", pa.string()),
    ])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        at, is_open, owner, first, held = None, False, None, False, []
        for file, block, line, begins_open, begun_in in _rows(batches):
            if (file, block) != at:
                if held:
                    yield *piece, False, first, "\n".join(held)
                at, is_open, held = (file, block), begins_open, []
                piece, first = (file, begun_in if begins_open else block, block), block == 0
            if quote in line:
                is_open = ends_open(line, is_open, separator, quote)
            held.append(line)
            if not is_open:
                yield *piece, piece[1] == block, first, "\n".join(held)
                held, first, piece = [], False, (file, block, block)
        if held:
            yield *piece, False, first, "\n".join(held)

    return lambda batches: _batches(records(batches), schema)


def read_records(spark: SparkSession, path: str, separator: str, quote: str) -> DataFrame:
    """``(first, record)``: the texts of all records, and whether one is the first of its file.

    Lines end with ``\\n`` or ``\\r\\n``; empty records are left out. The lines are shuffled once, by
    block; a block is at most what the session reads in one task (``spark.sql.files.maxPartitionBytes``).
    """
    scan = spark.read.option("lineSep", "\n").text(path)
    lines = scan.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    ends = stage(lines.mapInArrow(_block_ends(separator, quote), BLOCK_ROW), "block-ends")
    begins = stage(ends.groupBy("file").applyInPandas(_begins, START_ROW), "block-begins")
    placed = lines.withColumn("place", F.monotonically_increasing_id()).join(begins, ["file", "block"])
    ordered = placed.repartition("file", "block").sortWithinPartitions("file", "block", "place")
    made = stage(
        ordered.select("file", "block", "value", "begins_open", "owner").mapInArrow(_records(separator, quote), RECORD_ROW),
        "records",
    )
    pieces = made.where("not whole").groupBy("file", "owner").agg(
        F.max("first").alias("first"), F.array_sort(F.collect_list(F.struct("block", "record"))).alias("pieces")
    )
    joined = pieces.select("first", F.array_join(F.col("pieces.record"), "\n").alias("record"))
    every = made.where("whole").select("first", "record").unionByName(joined)
    return every.withColumn("record", F.regexp_replace("record", r"\r\z", "")).where("record <> ''")


def read_multiline(spark: SparkSession, path: str, schema: T.StructType, options: Mapping[str, str]) -> DataFrame:
    """The rows of delimited files with a header, whose names must be those of ``schema``."""
    records = read_records(spark, path, options["sep"], options["quote"])
    names = ", ".join(f"`{f.name}` string" for f in schema)
    header = F.from_csv("record", names, dict(options))
    wrong = F.to_json(header) != F.to_json(F.struct(*[F.lit(f.name).alias(f.name) for f in schema]))
    found = records.where("first").where(wrong).first()
    if found is not None:
        raise ValueError(f"header {found['record']!r} is not {schema.names}")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return records.where("not first").select(F.from_csv("record", types, dict(options)).alias("row")).select("row.*")
