"""Filters, projections, unions and sampling."""

from pyspark.sql import functions as F

from pricemill.catalog.registry import CATALOG, FILLED, with_listings
from pricemill.functions.text import blank_boilerplate, join_texts
from pricemill.operators.encode import downcast, fill_missing, null_flags
from pricemill.operators.ranking import head_rows
from pricemill.operators.sampling import corrupt_one_token, corrupt_tokens, modular_draw, replicate_rows
from pricemill.plans.cleaning import nonzero_price, union_train_test
from pricemill.sources import listings, with_row_id


@CATALOG.query(
    "scan_rename",
    """SELECT p_partkey AS id, p_name AS name, p_brand AS brand_name, p_type AS category_name,
              p_retailprice AS price FROM part""",
)
def scan_rename(spark, sf_dir):
    names = {
        "p_partkey": "id", "p_name": "name", "p_brand": "brand_name",
        "p_type": "category_name", "p_retailprice": "price",
    }
    parts = spark.read.schema(
        "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_retailprice DOUBLE"
    ).parquet(f"{sf_dir}/part.parquet")
    return parts.withColumnsRenamed(names)


@CATALOG.query(
    "filter_nonzero_price",
    with_listings("SELECT row_id, split, price FROM listings WHERE price IS DISTINCT FROM 0"),
)
def filter_nonzero_price(spark, sf_dir):
    return nonzero_price(listings(spark, sf_dir, False)).select("row_id", "split", "price")


@CATALOG.query(
    "filter_positive_price",
    with_listings("SELECT row_id, split, price FROM listings WHERE price > 0"),
)
def filter_positive_price(spark, sf_dir):
    return listings(spark, sf_dir, False).where("price > 0").select("row_id", "split", "price")


@CATALOG.query(
    "fill_missing",
    with_listings(
        """SELECT row_id, f.name, f.category_name, f.brand_name, f.item_description, f.item_condition_id,
                  f.shipping, lower(coalesce(l.brand_name, '')) AS brand_lower
           FROM filled f JOIN listings l USING (row_id)""",
        FILLED,
    ),
)
def fill_missing_query(spark, sf_dir):
    rows = listings(spark, sf_dir).withColumn("brand_lower", F.lower(F.coalesce("brand_name", F.lit(""))))
    return fill_missing(rows).drop("split", "price")


@CATALOG.query(
    "null_flags",
    with_listings(
        """SELECT row_id, (category_name IS NOT NULL)::INTEGER AS has_category,
                  (brand_name IS NOT NULL)::INTEGER AS has_brand FROM listings"""
    ),
)
def null_flags_query(spark, sf_dir):
    flags = {"has_category": "category_name", "has_brand": "brand_name"}
    return null_flags(listings(spark, sf_dir, False), flags).select("row_id", *flags)


@CATALOG.query(
    "blank_boilerplate",
    with_listings(
        """SELECT row_id, CASE WHEN lower(trim(item_description)) = 'no description yet' THEN ''
                               ELSE item_description END AS item_description FROM listings"""
    ),
)
def blank_boilerplate_query(spark, sf_dir):
    return listings(spark, sf_dir).select(
        "row_id", blank_boilerplate(F.col("item_description")).alias("item_description")
    )


@CATALOG.query(
    "head_rows",
    with_listings("SELECT row_id, name, price FROM listings ORDER BY row_id LIMIT 100"),
)
def head_rows_query(spark, sf_dir):
    return head_rows(listings(spark, sf_dir, False), 100).select("row_id", "name", "price")


@CATALOG.query(
    "downcast_types",
    with_listings(
        """SELECT row_id::INTEGER AS row_id, split, name, item_condition_id, category_name, brand_name,
                  price::FLOAT AS price, shipping FROM listings"""
    ),
)
def downcast_types(spark, sf_dir):
    return downcast(listings(spark, sf_dir, False))


@CATALOG.query(
    "expensive_unbranded",
    with_listings(
        "SELECT row_id, name, category_name, price FROM listings WHERE brand_name IS NULL AND price > 1000"
    ),
)
def expensive_unbranded(spark, sf_dir):
    rows = listings(spark, sf_dir, False).where(F.col("brand_name").isNull() & (F.col("price") > 1000))
    return rows.select("row_id", "name", "category_name", "price")


@CATALOG.query(
    "filter_brand",
    with_listings("SELECT row_id, name, brand_name FROM listings WHERE brand_name = 'Brand#4'"),
)
def filter_brand(spark, sf_dir):
    rows = listings(spark, sf_dir, False).where(F.col("brand_name") == "Brand#4")
    return rows.select("row_id", "name", "brand_name")


@CATALOG.query(
    "union_train_test",
    with_listings(
        """SELECT row_id, split, name, brand_name, price FROM listings WHERE split = 'train'
           UNION ALL SELECT row_id, split, name, brand_name, NULL FROM listings WHERE split = 'test'"""
    ),
)
def union_train_test_query(spark, sf_dir):
    rows = listings(spark, sf_dir, False).select("row_id", "split", "name", "brand_name", "price")
    return union_train_test(rows.where("split = 'train'"), rows.where("split = 'test'").drop("price"))


@CATALOG.query(
    "keyed_union",
    with_listings(
        """SELECT CASE WHEN split = 'train' THEN 2 * row_id ELSE 2 * (row_id - 3) + 1 END AS row_id,
                  CASE WHEN split = 'train' THEN row_id ELSE row_id - 3 END AS source_id, split, name, price
           FROM listings"""
    ),
)
def keyed_union(spark, sf_dir):
    """Both splits number their rows alike, as two files do; the union keeps them apart."""
    rows = listings(spark, sf_dir, False).select("row_id", "split", "name", "price")
    train = rows.where("split = 'train'").drop("split").withColumnRenamed("row_id", "train_id")
    test = rows.where("split = 'test'").selectExpr("row_id - 3 as test_id", "name")
    return union_train_test(with_row_id(train, "train_id", "train"), with_row_id(test, "test_id", "test"))


@CATALOG.query(
    "replicate_rows",
    with_listings(
        """SELECT row_id * 6 + c AS copy_id, row_id, name
           FROM listings, range(0, 6) r(c)
           WHERE split = 'test' AND (c < 5 OR row_id IN (
             SELECT row_id FROM listings WHERE split = 'test' ORDER BY row_id LIMIT 500))"""
    ),
)
def replicate_rows_query(spark, sf_dir):
    test = listings(spark, sf_dir, False).where("split = 'test'").select("row_id", "name")
    return replicate_rows(test, copies=5, head=500)


@CATALOG.query(
    "corrupt_tokens",
    with_listings(
        """SELECT row_id, array_to_string(list_transform(range(1, len(t) + 1),
               lambda j: CASE WHEN (row_id * 31 + (j - 1) * 17 + 7) % 100 < 40
                              THEN 'w' || ((row_id * 31 + (j - 1) * 17 + 8) % 100003)::VARCHAR
                              ELSE t[j] END), ' ') AS item_description
           FROM (SELECT row_id, string_split(coalesce(item_description, 'missvalue'), ' ') AS t FROM listings)"""
    ),
)
def corrupt_tokens_query(spark, sf_dir):
    rows = fill_missing(listings(spark, sf_dir)).select("row_id", "item_description")
    return corrupt_tokens(rows, "item_description", rate=40, draw=modular_draw)


@CATALOG.query(
    "corrupt_one_token",
    with_listings(
        """SELECT row_id, array_to_string(list_transform(range(1, len(t) + 1),
               lambda j: CASE WHEN j - 1 = (row_id * 31 + 7) % 1000003 % len(t)
                              THEN 'w' || ((row_id * 31 + 17 + 8) % 100003)::VARCHAR ELSE t[j] END), ' ') AS name
           FROM (SELECT row_id, string_split(name, ' ') AS t FROM listings)"""
    ),
)
def corrupt_one_token_query(spark, sf_dir):
    rows = listings(spark, sf_dir, False).select("row_id", "name")
    return corrupt_one_token(rows, "name", draw=modular_draw)


@CATALOG.query(
    "enrich_text",
    with_listings(
        """SELECT row_id, name || ' ' || brand_name AS name,
                  item_description || ' . . ' || name || ' . . ' || category_name AS item_description
           FROM filled""",
        FILLED,
    ),
)
def enrich_text(spark, sf_dir):
    rows = fill_missing(listings(spark, sf_dir))
    return rows.select(
        "row_id",
        join_texts([F.col("name"), F.col("brand_name")]).alias("name"),
        join_texts(
            [F.col("item_description"), F.col("name"), F.col("category_name")], " . . "
        ).alias("item_description"),
    )
