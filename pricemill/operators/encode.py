"""Frequencies, unseen values, label codes, word indices and sequences."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from pricemill.constants import MISSING, VOCABULARY_SIZE
from pricemill.functions.sequences import pad_left
from pricemill.operators.joins import key_counts, lookup_join
from pricemill.operators.ranking import global_rank


def fill_missing(
    df: DataFrame,
    text_columns: Sequence[str] = ("name", "category_name", "brand_name", "item_description"),
    defaults: dict[str, int] | None = None,
    sentinel: str = MISSING,
) -> DataFrame:
    """Write the sentinel into null texts and defaults into null class ids (as 32-bit integers)."""
    defaults = {"item_condition_id": 1, "shipping": 0} if defaults is None else defaults
    text = {c: F.coalesce(F.col(c), F.lit(sentinel)) for c in text_columns if c in df.columns}
    codes = {c: F.coalesce(F.col(c), F.lit(v)).cast("int") for c, v in defaults.items() if c in df.columns}
    return df.withColumns({**text, **codes})


def null_flags(df: DataFrame, flags: dict[str, str]) -> DataFrame:
    """Add ``flag = 1`` where the source column is not null, else 0."""
    return df.withColumns({flag: F.col(source).isNotNull().cast("int") for flag, source in flags.items()})


def downcast(df: DataFrame) -> DataFrame:
    """64-bit integers and floats become 32-bit."""
    narrow = {T.LongType: "int", T.DoubleType: "float"}
    return df.select(
        *[
            F.col(f.name).cast(narrow[type(f.dataType)]).alias(f.name) if type(f.dataType) in narrow else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per non-null value (unordered; order on display)."""
    return key_counts(df, column)


def frequency_join(
    df: DataFrame,
    column: str,
    row_id: str = "row_id",
    sentinel: str = MISSING,
    counted: DataFrame | None = None,
    measure: bool = True,
) -> DataFrame:
    """Add ``<column>_frec``: how many rows share the value; the sentinel counts as zero.
    ``counted`` may give the same rows by a cheaper plan (fewer joins) to count from;
    ``measure``: see :func:`lookup_join`."""
    counts = key_counts(df if counted is None else counted, column, "_n").withColumn("_frequency", F.col("_n"))
    joined = lookup_join(df, counts, column, F.col(row_id), weight="_n", measure=measure)
    frequency = F.when(F.col(column) == sentinel, F.lit(0)).otherwise(F.col("_frequency")).cast("bigint")
    return joined.withColumn(f"{column}_frec", frequency).drop("_frequency")


def seen_in_train(df: DataFrame, column: str) -> DataFrame:
    """Every value with its row count and whether a train row has it."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("_n"), (F.count_if(F.col("split") == "train") > 0).alias("_seen"))
    )


def mask_unseen(df: DataFrame, column: str, row_id: str = "row_id", sentinel: str = MISSING) -> DataFrame:
    """Values that no train row has become the sentinel."""
    seen = seen_in_train(df, column)
    joined = lookup_join(df, seen, column, F.col(row_id), weight="_n", measure=True)
    return joined.withColumn(column, F.when(F.col("_seen"), F.col(column)).otherwise(sentinel)).drop("_seen")


def unseen_counts(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Rows per column whose value no train row has; read off the value table, no join."""
    parts = [
        seen_in_train(df, c).agg(
            F.lit(c).alias("column_name"),
            F.coalesce(F.sum(F.when(~F.col("_seen"), F.col("_n"))), F.lit(0)).cast("bigint").alias("unseen_rows"),
        )
        for c in columns
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """Zero-based code of every value in sorted order, with its row count ``n``."""
    codes, _ = global_rank(key_counts(df, column), [], row_id=column, name="code")
    return codes


def label_encode(df: DataFrame, column: str, codes: DataFrame | None = None, row_id: str = "row_id") -> DataFrame:
    """Add ``lb_<column>``."""
    codes = label_codes(df, column) if codes is None else codes
    table = codes.select(column, "n", F.col("code").alias(f"lb_{column}"))
    return lookup_join(df, table, column, F.col(row_id), weight="n", measure=True)


def select_fields(df: DataFrame, categorical: Iterable[str] = (), row_id: str = "row_id") -> DataFrame:
    """Every column as model input, by its kind: categorical ones become codes in sorted order
    (:func:`label_codes`; null stays null), booleans 0 or 1, decimals doubles; texts and other numbers stay.
    Columns of other types are an error."""
    categorical = list(categorical)
    if unknown := set(categorical) - set(df.columns):
        raise ValueError(f"no such columns: {sorted(unknown)}")

    def plain(field: T.StructField) -> Column:
        column, kind = F.col(field.name), field.dataType
        if field.name in categorical or field.name == row_id or isinstance(kind, T.StringType):
            return column
        if isinstance(kind, T.BooleanType):
            return column.cast("int").alias(field.name)
        if isinstance(kind, T.DecimalType):
            return column.cast("double").alias(field.name)
        if isinstance(kind, T.NumericType):
            return column
        raise TypeError(f"{field.name}: no model input from {kind.simpleString()}")

    chosen = df.select(*[plain(f) for f in df.schema.fields])
    for name in categorical:
        encoded = label_encode(chosen, name, label_codes(df, name), row_id)
        chosen = encoded.withColumn(name, F.col(f"lb_{name}")).select(*df.columns)
    return chosen


def encoded_sizes(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Largest code plus one per column: codes are dense, so that is the number of values."""
    values = [F.count_distinct(c).cast("bigint").alias(c) for c in columns]
    wide = df.agg(*values)
    return wide.unpivot([], list(wide.columns), "column_name", "size")


def split_words(text: Column) -> Column:
    """Lower-case words between spaces; no empty ones."""
    return F.filter(F.split(F.lower(text), " ", -1), lambda w: w != "")


def word_index(df: DataFrame, column: str, size: int = VOCABULARY_SIZE, row_id: str = "row_id") -> DataFrame:
    """The ``size - 1`` most frequent words numbered from 1, ties by first appearance (row id,
    then place). The limit comes before the numbering, so the single-task window sees only the
    bounded vocabulary."""
    words = df.select(F.col(row_id), F.posexplode(split_words(F.col(column))).alias("pos", "word"))
    place = F.struct(F.col(row_id), F.col("pos"))
    if isinstance(df.schema[row_id].dataType, T.IntegralType):
        # in the same order, but of fixed width: words are hashed, while structs have every occurrence sorted
        place = F.col(row_id).cast("decimal(20,0)") * F.lit(2**32).cast("decimal(11,0)") + F.col("pos").cast("decimal(11,0)")
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    top = counted.orderBy(F.desc("n"), F.asc("first")).limit(size - 1)
    number = F.row_number().over(Window.orderBy(F.desc("n"), F.asc("first")))
    return top.select("word", number.alias("idx"), "n")


def vocabulary_size(df: DataFrame, column: str, size: int = VOCABULARY_SIZE) -> DataFrame:
    """``min(distinct words + 1, size)``."""
    words = df.select(F.explode(split_words(F.col(column))).alias("word")).distinct()
    return words.agg(F.least(F.count(F.lit(1)) + 1, F.lit(size)).cast("bigint").alias("size"))


def _numbered(vocabulary: Broadcast):
    """Arrow batches ``(id, words)`` to ``(id, numbers)``; one look-up for all words of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, numbers = (pa.array(v, t) for v, t in zip(vocabulary.value, (pa.string(), pa.int32()), strict=True))
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            found = numbers.take(pc.index_in(flat.cast(pa.string()), value_set=words))
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            kept = np.concatenate(([0], np.cumsum(found.is_valid().to_numpy(zero_copy_only=False))))
            offsets = pa.array(kept[np.concatenate(([0], ends)).astype(np.int64)], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, found.drop_null())], names=batch.schema.names)

    return run


def text_to_sequence(
    df: DataFrame, column: str, index: DataFrame, row_id: str = "row_id", name: str | None = None
) -> DataFrame:
    """``(row_id, sequence)``: word numbers in text order, unknown words left out; a null text has none.

    ``index`` is bounded by the vocabulary size (:func:`word_index`), so it is sent to all tasks, and
    no row leaves its task.
    """
    name = name or f"seq_{column}"
    entries = index.select("word", F.col("idx").cast("int").alias("idx")).toArrow()  # at most a vocabulary
    vocabulary = df.sparkSession.sparkContext.broadcast((entries["word"].to_pylist(), entries["idx"].to_pylist()))
    words = df.select(F.col(row_id), F.coalesce(split_words(F.col(column)), F.array().cast("array<string>")).alias(name))
    schema = T.StructType([words.schema[row_id], T.StructField(name, T.ArrayType(T.IntegerType()))])
    return words.mapInArrow(_numbered(vocabulary), schema)


def pad_sequences(df: DataFrame, column: str, length: int) -> DataFrame:
    """Left-pad with zeros or keep the last ``length`` numbers."""
    return df.withColumn(column, pad_left(F.col(column), length))
