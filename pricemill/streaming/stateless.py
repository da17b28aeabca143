"""The stateless operators on a streaming DataFrame. No operator here keeps state: statistics come
from tables fitted on batch data and are joined in as the static side."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pricemill.constants import MISSING
from pricemill.functions.text import token_overlap, word_length
from pricemill.plans.cleaning import clean_listings


def clean_stream(stream: DataFrame) -> DataFrame:
    """Clean listings as they arrive and measure their texts."""
    cleaned = clean_listings(stream)
    return cleaned.withColumns(
        {
            "item_description_word_len": word_length(F.col("item_description")),
            "brand_name_name_intsct": token_overlap(F.col("brand_name"), F.col("name")),
        }
    )


def with_frequencies(stream: DataFrame, counts: DataFrame, column: str, sentinel: str = MISSING) -> DataFrame:
    """Add ``<column>_frec`` from a fitted ``(column, n)`` table; unknown values count as zero."""
    joined = stream.join(counts.select(column, F.col("n").alias("_n")), column, "left")
    known = F.when(F.col(column) == sentinel, F.lit(0)).otherwise(F.coalesce("_n", F.lit(0)))
    return joined.withColumn(f"{column}_frec", known.cast("bigint")).drop("_n")
