"""Counts, statistics and scaled columns."""

from pyspark.sql import functions as F

from pricemill.catalog.registry import CATALOG, FILLED, with_cleaned, with_listings
from pricemill.operators.encode import fill_missing, value_counts
from pricemill.operators.fuzzy import term_dictionary
from pricemill.operators.scale import max_scale, shared, zscore
from pricemill.plans.cleaning import clean_listings
from pricemill.plans.hand_features import HAND_FEATURES, hand_features, raw_hand_features
from pricemill.sources import listings

RAW_HAND = """raw AS MATERIALIZED (
  SELECT row_id, split,
         CASE WHEN brand_name = 'missvalue' THEN 0 ELSE n END AS brand_name_frec,
         len(string_split(item_description, ' ')) AS item_description_word_len,
         len(list_intersect(b, string_split(name, ' '))) / (len(list_distinct(b)) + 1) AS brand_name_name_intsct,
         len(list_intersect(b, string_split(item_description, ' '))) / (len(list_distinct(b)) + 1)
           AS brand_name_item_description_intsct
  FROM (SELECT *, string_split(brand_name, ' ') AS b FROM cleaned)
  JOIN (SELECT brand_name, count(*) AS n FROM cleaned GROUP BY brand_name) USING (brand_name))"""


def hand_feature_rows(spark, sf_dir):
    """Unscaled hand features; brands are counted from ``part`` alone."""
    cleaned = clean_listings(listings(spark, sf_dir))
    counted = clean_listings(listings(spark, sf_dir, with_description=False))
    return cleaned, counted


@CATALOG.query(
    "hand_features",
    with_cleaned(
        """SELECT row_id, split,
                  round(ln(1 + brand_name_frec) / (SELECT max(ln(1 + brand_name_frec)) FROM raw), 9) AS brand_name_frec,
                  round(ln(1 + item_description_word_len) / (SELECT max(ln(1 + item_description_word_len)) FROM raw), 9)
                    AS item_description_word_len,
                  round(brand_name_name_intsct, 9) AS brand_name_name_intsct,
                  round(brand_name_item_description_intsct, 9) AS brand_name_item_description_intsct
           FROM raw""",
        RAW_HAND,
    ),
)
def hand_features_query(spark, sf_dir):
    features = hand_features(*hand_feature_rows(spark, sf_dir))
    return features.select("row_id", "split", *[F.round(c, 9).alias(c) for c in HAND_FEATURES])


@CATALOG.query(
    "zscore_features",
    with_cleaned(
        "SELECT row_id, "
        + ", ".join(
            f"round(({c} - (SELECT avg({c}) FROM raw)) / (SELECT stddev_pop({c}) FROM raw), 6) AS {c}"
            for c in [*HAND_FEATURES, "shipping"]
        )
        + " FROM raw JOIN (SELECT row_id, shipping FROM cleaned) USING (row_id)",
        RAW_HAND,
    ).replace("avg(shipping) FROM raw", "avg(shipping) FROM cleaned").replace(
        "stddev_pop(shipping) FROM raw", "stddev_pop(shipping) FROM cleaned"
    ),
)
def zscore_features(spark, sf_dir):
    cleaned, counted = hand_feature_rows(spark, sf_dir)
    columns = [*HAND_FEATURES, "shipping"]
    narrow = raw_hand_features(cleaned, counted, keep=["shipping"]).drop("split")
    scaled = zscore(shared(narrow, "row_id"), columns)
    return scaled.select("row_id", *[F.round(c, 6).alias(c) for c in columns])


@CATALOG.query(
    "max_scale",
    """SELECT o_orderkey, round(ln(1 + o_totalprice) / (SELECT ln(1 + max(o_totalprice)) FROM orders), 9) AS o_totalprice
       FROM orders""",
)
def max_scale_query(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")
    return max_scale(orders, ["o_totalprice"]).withColumn("o_totalprice", F.round("o_totalprice", 9))


@CATALOG.query(
    "value_counts",
    with_listings(
        "SELECT category_name, count(*) AS n FROM listings WHERE category_name IS NOT NULL GROUP BY ALL"
    ),
)
def value_counts_query(spark, sf_dir):
    return value_counts(listings(spark, sf_dir, False), "category_name")


@CATALOG.query(
    "brand_frequency",
    with_listings("SELECT brand_name, count(*) AS n FROM filled GROUP BY ALL", FILLED),
)
def brand_frequency(spark, sf_dir):
    return value_counts(fill_missing(listings(spark, sf_dir, False)), "brand_name")


@CATALOG.query(
    "distinct_brands",
    with_listings("SELECT DISTINCT brand_name FROM listings WHERE split = 'train'"),
)
def distinct_brands(spark, sf_dir):
    return listings(spark, sf_dir, False).where("split = 'train'").select("brand_name").distinct()


@CATALOG.query(
    "term_dictionary",
    with_listings(
        """SELECT term, count(*) AS n
           FROM (SELECT unnest(regexp_extract_all(lower(item_description), '[a-z]+')) AS term FROM listings)
           GROUP BY term"""
    ),
)
def term_dictionary_query(spark, sf_dir):
    return term_dictionary(listings(spark, sf_dir), "item_description")
