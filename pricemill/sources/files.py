"""Readers and writers: tab-separated listings, renamed columns, predictions, stage tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pricemill.sources.multiline import read_multiline

RAW_FIELDS = [
    T.StructField("name", T.StringType()),
    T.StructField("item_condition_id", T.IntegerType()),
    T.StructField("category_name", T.StringType()),
    T.StructField("brand_name", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("shipping", T.IntegerType()),
    T.StructField("item_description", T.StringType()),
]


def raw_schema(split: str) -> T.StructType:
    """Schema of a raw file: ``train`` files have a price, ``test`` files do not."""
    fields = RAW_FIELDS if split == "train" else [f for f in RAW_FIELDS if f.name != "price"]
    return T.StructType([T.StructField(f"{split}_id", T.LongType()), *fields])


def read_delimited(spark: SparkSession, path: str, schema: T.StructType, multiline: bool = False) -> DataFrame:
    """Tab-separated UTF-8 text with a header row and declared types (no inference pass).

    A field may be quoted, and a quote inside it is doubled. With ``multiline`` quoted fields may hold line
    breaks; a file is still read by many tasks (:mod:`pricemill.sources.multiline`), at the price of two more
    passes and a shuffle of the lines, so it is off unless asked for.
    """
    options = {"sep": "\t", "quote": '"', "escape": '"'}
    if multiline:
        return read_multiline(spark, path, schema, options)
    return spark.read.schema(schema).options(header=True, encoding="UTF-8", enforceSchema=False, **options).csv(path)


def with_row_id(rows: DataFrame, id_column: str, split: str) -> DataFrame:
    """``row_id`` unique over both splits (even for train, odd for test), the file's own id as
    ``source_id``, and ``split``. Ids of both files begin at 0, so alone they would name two rows."""
    number = 2 * F.col(id_column) + F.lit(0 if split == "train" else 1)
    rest = [c for c in rows.columns if c != id_column]
    return rows.select(
        number.cast("bigint").alias("row_id"), F.col(id_column).alias("source_id"), *rest, F.lit(split).alias("split")
    )


def source_ids(rows: DataFrame) -> DataFrame:
    """Put the file's own id in place of ``row_id``, as a submission of one split needs it."""
    return rows.withColumn("row_id", F.shiftright("row_id", 1))


def read_listings_tsv(spark: SparkSession, path: str, split: str, multiline: bool = False) -> DataFrame:
    """Read ``train`` or ``test`` listings with the keys of :func:`with_row_id`, so later steps never
    tell the splits apart by row position."""
    return with_row_id(read_delimited(spark, path, raw_schema(split), multiline), f"{split}_id", split)


def read_renamed(
    spark: SparkSession, path: str, schema: T.StructType, names: Mapping[str, str]
) -> DataFrame:
    """Read a delimited file and rename columns."""
    return read_delimited(spark, path, schema).withColumnsRenamed(dict(names))


def write_predictions(predictions: DataFrame, path: str, id_column: str = "row_id") -> None:
    """Write ``id, price`` with a header, one file per partition."""
    predictions.select(id_column, "price").write.mode("errorifexists").option("header", True).csv(path)


def read_predictions(spark: SparkSession, path: str, id_column: str = "row_id") -> DataFrame:
    """Read back what :func:`write_predictions` wrote."""
    return spark.read.schema(f"{id_column} BIGINT, price DOUBLE").option("header", True).csv(path)


def save_stage(df: DataFrame, root: str, name: str) -> None:
    """Keep an intermediate table under a stage name."""
    df.write.mode("overwrite").parquet(f"{root.rstrip('/')}/{name}")


def load_stage(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Load what :func:`save_stage` kept."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}")


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """A dictionary from plain text: ``(term, n)`` with every lower-case word of the file and its count."""
    words = F.explode(F.regexp_extract_all(F.lower("value"), F.lit("[a-z]+"), F.lit(0)))
    return spark.read.text(path).select(words.alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def write_term_counts(counts: DataFrame, path: str) -> None:
    """Dump a term/count table (brand frequencies, a dictionary) as tab-separated text."""
    counts.write.mode("errorifexists").option("sep", "\t").csv(path)
