"""From raw listings to clean columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pricemill.constants import MISSING, MISSING_CATEGORY_PATH
from pricemill.functions.text import (
    blank_boilerplate,
    category_levels_2,
    category_levels_3,
    clean_keep,
    clean_whitelist,
    cross_key,
    join_texts,
    lower_or_empty,
    normalize_units,
)
from pricemill.operators.brands import impute_brand_cascade
from pricemill.operators.encode import fill_missing, null_flags


def nonzero_price(df: DataFrame) -> DataFrame:
    """Drop free listings; a null price (a test row) stays."""
    return df.where(~F.col("price").eqNullSafe(0))


def union_train_test(train: DataFrame, test: DataFrame) -> DataFrame:
    """Stack the splits by column name; columns that one lacks are null there."""
    return train.unionByName(test, allowMissingColumns=True)


def clean_listings(raw: DataFrame) -> DataFrame:
    """Filter, fill, clean the texts and split the category; one projection over the scan."""
    filled = fill_missing(nonzero_price(raw))
    cleaners = {
        "name": clean_keep,
        "item_description": clean_keep,
        "brand_name": clean_whitelist,
        "category_name": clean_whitelist,
    }
    cleaned = filled.withColumns({c: f(F.col(c)) for c, f in cleaners.items() if c in filled.columns})
    first, second = category_levels_2(F.col("category_name"), MISSING)
    return cleaned.withColumns({"category_1": first, "category_2": second})


def lowered_listings(raw: DataFrame, impute: bool = True) -> DataFrame:
    """The lower-case branch: flags, three category levels, cross keys, units, brand cascade and
    enriched texts."""
    flagged = null_flags(raw, {"has_category": "category_name", "has_brand": "brand_name"})
    category = F.lower(F.coalesce("category_name", F.lit(MISSING_CATEGORY_PATH)))
    rows = flagged.withColumn("category_name", category)
    rows = rows.withColumns(category_levels_3(F.col("category_name")))
    rows = rows.withColumns(
        {
            "gencat_cond": cross_key(F.col("general_cat"), F.col("item_condition_id")),
            "subcat_1_cond": cross_key(F.col("subcat_1"), F.col("item_condition_id")),
            "subcat_2_cond": cross_key(F.col("subcat_2"), F.col("item_condition_id")),
            "name": normalize_units(lower_or_empty(F.col("name"))),
            "brand_name": lower_or_empty(F.col("brand_name")),
            "item_description": normalize_units(
                blank_boilerplate(lower_or_empty(F.col("item_description")))
            ),
        }
    )
    if impute:
        rows = impute_brand_cascade(rows)
    return enrich(rows)


def enrich(rows: DataFrame) -> DataFrame:
    """Brand behind the name; name, categories and brand behind the description."""
    named = rows.withColumn("name", join_texts([F.col("name"), F.col("brand_name")]))
    tail = [F.col(c) for c in ("item_description", "name", "subcat_1", "subcat_2", "general_cat", "brand_name")]
    return named.withColumn("item_description", join_texts(tail))


def separated_description(rows: DataFrame, separator: str = " . . ") -> DataFrame:
    """Second category level, name and description with a separator between."""
    parts = [F.col("category_2"), F.col("name"), F.col("item_description")]
    return rows.withColumn("item_description", join_texts(parts, separator))
