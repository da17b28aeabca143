"""Joins, ranks, codes, folds and sequences."""

from pyspark.sql import functions as F

from pricemill.catalog.registry import CATALOG, FILLED, with_cleaned, with_listings
from pricemill.constants import DESCRIPTION_LENGTH, NAME_LENGTH
from pricemill.operators import encode as E
from pricemill.operators.ranking import contiguous_folds, hashed_folds, rank_gauss, row_numbers
from pricemill.functions.numeric import erfinv_sql
from pricemill.plans.cleaning import clean_listings
from pricemill.session import stage
from pricemill.sources import listings


@CATALOG.query(
    "brand_frequency_join",
    with_listings(
        """SELECT row_id, brand_name, CASE WHEN brand_name = 'missvalue' THEN 0 ELSE n END AS brand_name_frec
           FROM filled JOIN (SELECT brand_name, count(*) AS n FROM filled GROUP BY ALL) USING (brand_name)""",
        FILLED,
    ),
)
def brand_frequency_join(spark, sf_dir):
    rows = E.fill_missing(listings(spark, sf_dir, False)).select("row_id", "brand_name")
    return E.frequency_join(rows, "brand_name")


@CATALOG.query(
    "mask_unseen",
    with_listings(
        """SELECT row_id,
                  CASE WHEN category_name IN (SELECT category_name FROM filled WHERE split = 'train')
                       THEN category_name ELSE 'missvalue' END AS category_name,
                  CASE WHEN brand_name IN (SELECT brand_name FROM filled WHERE split = 'train')
                       THEN brand_name ELSE 'missvalue' END AS brand_name
           FROM filled""",
        FILLED,
    ),
)
def mask_unseen(spark, sf_dir):
    rows = E.fill_missing(listings(spark, sf_dir, False)).select("row_id", "split", "category_name", "brand_name")
    masked = E.mask_unseen(E.mask_unseen(rows, "category_name"), "brand_name")
    return masked.drop("split")


@CATALOG.query(
    "unseen_counts",
    with_listings(
        """SELECT 'category_name' AS column_name, count(*) AS unseen_rows FROM filled
           WHERE category_name NOT IN (SELECT category_name FROM filled WHERE split = 'train')
           UNION ALL
           SELECT 'brand_name', count(*) FROM filled
           WHERE brand_name NOT IN (SELECT brand_name FROM filled WHERE split = 'train')""",
        FILLED,
    ),
)
def unseen_counts(spark, sf_dir):
    return E.unseen_counts(E.fill_missing(listings(spark, sf_dir, False)), ["category_name", "brand_name"])


@CATALOG.query(
    "label_encode",
    with_listings(
        """SELECT row_id, category_name, (dense_rank() OVER (ORDER BY category_name) - 1)::BIGINT AS lb_category_name
           FROM filled""",
        FILLED,
    ),
)
def label_encode(spark, sf_dir):
    rows = E.fill_missing(listings(spark, sf_dir, False)).select("row_id", "category_name")
    return E.label_encode(rows, "category_name")


@CATALOG.query(
    "select_fields",
    with_listings(
        """SELECT row_id, name, item_condition_id, price, (shipping = 1)::INTEGER AS shipped,
                  CASE WHEN brand_name IS NOT NULL THEN b.code END AS brand_name,
                  CASE WHEN category_name IS NOT NULL THEN c.code END AS category_name
           FROM listings LEFT JOIN brands b USING (brand_name) LEFT JOIN categories c USING (category_name)""",
        "brands AS (SELECT brand_name, row_number() OVER (ORDER BY brand_name) - 1 AS code FROM (SELECT DISTINCT brand_name FROM listings WHERE brand_name IS NOT NULL))",
        "categories AS (SELECT category_name, row_number() OVER (ORDER BY category_name) - 1 AS code FROM (SELECT DISTINCT category_name FROM listings WHERE category_name IS NOT NULL))",
    ),
)
def select_fields(spark, sf_dir):
    rows = listings(spark, sf_dir, False).withColumn("shipped", F.col("shipping") == 1)
    fields = rows.select("row_id", "name", "item_condition_id", "price", "shipped", "brand_name", "category_name")
    return E.select_fields(fields, ["brand_name", "category_name"])


@CATALOG.query(
    "encoded_sizes",
    with_listings(
        """SELECT 'brand_name' AS column_name, count(DISTINCT brand_name) AS size FROM filled
           UNION ALL SELECT 'category_name', count(DISTINCT category_name) FROM filled
           UNION ALL SELECT 'item_description', least(count(DISTINCT w) + 1, 50000)
                     FROM (SELECT unnest(string_split(lower(item_description), ' ')) AS w FROM filled WHERE split = 'train')
                     WHERE w <> ''""",
        FILLED,
    ),
)
def encoded_sizes(spark, sf_dir):
    codes = E.encoded_sizes(E.fill_missing(listings(spark, sf_dir, False)), ["brand_name", "category_name"])
    train = E.fill_missing(listings(spark, sf_dir)).where("split = 'train'")
    words = E.vocabulary_size(train, "item_description")
    return codes.unionByName(words.select(F.lit("item_description").alias("column_name"), "size"))


@CATALOG.query(
    "rank_gauss",
    f"""WITH r AS (SELECT o_orderkey, (row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) AS k,
                          count(*) OVER () AS n FROM orders),
             c AS (SELECT o_orderkey, (2 * k - (n - 1)) / n::DOUBLE AS x FROM r)
        SELECT o_orderkey, round({erfinv_sql("x")}, 8) AS gauss FROM c""",
)
def rank_gauss_query(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")
    ranked = rank_gauss(orders, "o_totalprice", "o_orderkey")
    return ranked.select("o_orderkey", F.round("gauss", 8).alias("gauss"))


@CATALOG.query(
    "rank_gauss_tied",
    f"""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
                          (row_number() OVER (ORDER BY l_quantity, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1) AS k,
                          count(*) OVER () AS n FROM lineitem)
        SELECT l_quantity, count(*) AS n_rows, round(min(g), 8) AS low, round(max(g), 8) AS high
        FROM (SELECT l_quantity, {erfinv_sql("(2 * k - (n - 1)) / n::DOUBLE")} AS g FROM r) GROUP BY l_quantity""",
)
def rank_gauss_tied(spark, sf_dir):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*keys, "l_quantity")
    ranked = rank_gauss(lines, "l_quantity", keys)
    return ranked.groupBy("l_quantity").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.min("gauss"), 8).alias("low"), F.round(F.max("gauss"), 8).alias("high")
    )


@CATALOG.query(
    "row_numbers",
    "SELECT event_id, user_id, row_number() OVER (ORDER BY event_id) - 1 AS number FROM events",
)
def row_numbers_query(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id")
    return row_numbers(events, "event_id")


@CATALOG.query(
    "kfold_contiguous",
    with_listings(
        """SELECT row_id, (CASE WHEN k < (n % 7) * (n // 7 + 1) THEN k // (n // 7 + 1)
                                ELSE n % 7 + (k - (n % 7) * (n // 7 + 1)) // (n // 7) END)::INTEGER AS fold
           FROM (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS k, count(*) OVER () AS n
                 FROM listings WHERE price > 0)"""
    ),
)
def kfold_contiguous(spark, sf_dir):
    rows = listings(spark, sf_dir, False).where("price > 0").select("row_id")
    return contiguous_folds(rows, 7)


@CATALOG.query("kfold_hashed")
def kfold_hashed(spark, sf_dir):
    return hashed_folds(listings(spark, sf_dir, False).select("row_id"), 5, seed=2018)


WORDS = """words AS (
  SELECT row_id, split, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos
  FROM (SELECT row_id, split, string_split(lower(item_description), ' ') AS w FROM cleaned)),
word_index AS MATERIALIZED (
  SELECT word, row_number() OVER (ORDER BY n DESC, f.r, f.p) AS idx, n
  FROM (SELECT word, count(*) AS n, min({'r': row_id, 'p': pos}) AS f
        FROM words WHERE split = 'train' AND word <> '' GROUP BY word)
  QUALIFY idx < 50000)"""


def _description_index(cleaned):
    return E.word_index(cleaned.where("split = 'train'"), "item_description")


@CATALOG.query("word_index", with_cleaned("SELECT word, idx::INTEGER AS idx, n FROM word_index", WORDS))
def word_index(spark, sf_dir):
    return _description_index(clean_listings(listings(spark, sf_dir)))


SEQUENCES = """sequences AS (
  SELECT c.row_id, coalesce(s.seq, []) AS seq
  FROM cleaned c LEFT JOIN (SELECT row_id, list(idx ORDER BY pos) AS seq
                            FROM words JOIN word_index USING (word) GROUP BY row_id) s USING (row_id))"""


@CATALOG.query(
    "text_to_sequence",
    with_cleaned(
        "SELECT row_id, array_to_string(seq, ',') AS seq_item_description FROM sequences", WORDS, SEQUENCES
    ),
)
def text_to_sequence(spark, sf_dir):
    cleaned = stage(clean_listings(listings(spark, sf_dir)).select("row_id", "split", "item_description"), "descriptions")
    sequences = E.text_to_sequence(cleaned, "item_description", _description_index(cleaned))
    return sequences.withColumn("seq_item_description", F.array_join("seq_item_description", ","))


@CATALOG.query(
    "pad_sequence",
    with_cleaned(
        """SELECT row_id, array_to_string(list_concat(list_transform(range(0, greatest(85 - len(seq), 0)), lambda i: 0),
                                          seq[greatest(len(seq) - 84, 1):]), ',') AS seq_item_description
           FROM sequences""",
        WORDS,
        SEQUENCES,
    ),
)
def pad_sequence(spark, sf_dir):
    cleaned = stage(clean_listings(listings(spark, sf_dir)).select("row_id", "split", "item_description"), "descriptions")
    sequences = E.text_to_sequence(cleaned, "item_description", _description_index(cleaned))
    padded = E.pad_sequences(sequences, "seq_item_description", DESCRIPTION_LENGTH)
    return padded.withColumn("seq_item_description", F.array_join("seq_item_description", ","))


@CATALOG.query(
    "pad_name_sequence",
    with_cleaned(
        """SELECT row_id, array_to_string(list_concat(list_transform(range(0, greatest(10 - len(seq), 0)), lambda i: 0),
                                          seq[greatest(len(seq) - 9, 1):]), ',') AS seq_name
           FROM sequences""",
        WORDS.replace("item_description", "name"),
        SEQUENCES,
    ),
)
def pad_name_sequence(spark, sf_dir):
    cleaned = clean_listings(listings(spark, sf_dir, False)).select("row_id", "split", "name")
    index = E.word_index(cleaned.where("split = 'train'"), "name")
    padded = E.pad_sequences(E.text_to_sequence(cleaned, "name", index), "seq_name", NAME_LENGTH)
    return padded.withColumn("seq_name", F.array_join("seq_name", ","))
