"""Vectorisers, document-frequency filters, TF-IDF and feature unions."""

from pyspark.sql import functions as F

from pricemill.catalog.brands import cascade_sql
from pricemill.catalog.registry import CATALOG, FILLED, with_cleaned, with_listings
from pricemill.catalog.text import LEVELS_3, _units
from pricemill.constants import DESCRIPTION_NGRAM_WEIGHTS, HASH_SLOTS, NAME_NGRAM_WEIGHTS
from pricemill.functions.sequences import bag
from pricemill.operators import features as X
from pricemill.operators.grams import Grams, with_grams
from pricemill.plans.blocks import tfidf_union, weighted_blocks
from pricemill.plans.cleaning import clean_listings, lowered_listings, separated_description
from pricemill.sources import listings

TOKEN = "[\\p{L}\\p{N}_]{2,}"


def counted(column: str, source: str = "cleaned") -> str:
    """Word counts per row of one column."""
    return f"""counted AS MATERIALIZED (
  SELECT row_id, split, feature, count(*)::DOUBLE AS value
  FROM (SELECT row_id, split, unnest(regexp_extract_all(lower({column}), '{TOKEN}')) AS feature FROM {source})
  GROUP BY ALL)"""


def grams(column: str, orders: int, source: str, tokens: str) -> str:
    """One row per n-gram occurrence of ``column``: ``(row_id, split, k, feature)``."""
    parts = [
        f"""SELECT row_id, split, {k} AS k, unnest(list_transform(range(1, len(w) - {k - 2}),
              lambda i: array_to_string(w[i:i + {k - 1}], ' '))) AS feature FROM tokens WHERE len(w) >= {k}"""
        for k in range(1, orders + 1)
    ]
    return (
        f"tokens AS MATERIALIZED (SELECT row_id, split, {tokens} AS w FROM {source}),\n"
        f"grams AS MATERIALIZED ({' UNION ALL '.join(parts)})"
    )


def words_without_stops(column: str) -> str:
    return (
        f"list_filter(regexp_extract_all({column}, '{TOKEN}'), "
        "lambda t: t NOT IN ('the', 'a', 'an', 'is', 'it', 'this'))"
    )


def space_words(column: str) -> str:
    return f"list_filter(string_split({column}, ' '), lambda t: t <> '')"


def _clean(spark, sf_dir, with_description=True):
    return clean_listings(listings(spark, sf_dir, with_description))


def _words(spark, sf_dir, *keep):
    """Word counts of the descriptions."""
    return X.explode_bag(_clean(spark, sf_dir), X.count_bag(F.col("item_description")), *keep)


@CATALOG.query(
    "count_vectorize",
    with_cleaned("SELECT row_id, feature, value FROM counted", counted("category_name || ' ' || brand_name")),
)
def count_vectorize(spark, sf_dir):
    text = F.concat_ws(" ", "category_name", "brand_name")
    return X.explode_bag(_clean(spark, sf_dir, False), X.count_bag(text))


@CATALOG.query(
    "whole_value_onehot",
    with_listings(
        """SELECT row_id, key AS feature, 1.0::DOUBLE AS value
           FROM (SELECT row_id, general_cat || '_' || coalesce(item_condition_id, 1)::VARCHAR AS key FROM levels)
           WHERE key IN (SELECT general_cat || '_' || coalesce(item_condition_id, 1)::VARCHAR FROM levels
                         GROUP BY 1 HAVING count(*) >= 2)""",
        LEVELS_3,
    ),
)
def whole_value_onehot(spark, sf_dir):
    rows = listings(spark, sf_dir, False).fillna({"item_condition_id": 1})
    lowered = lowered_listings(rows.withColumn("item_description", F.lit("")), impute=False)
    return X.whole_value_onehot(lowered, "gencat_cond", min_df=2)


@CATALOG.query(
    "onehot_features",
    with_cleaned(
        """SELECT row_id, 'category_name=' || category_name AS feature, 1.0::DOUBLE AS value FROM cleaned
           UNION ALL SELECT row_id, 'brand_name=' || brand_name, 1.0 FROM cleaned
           UNION ALL SELECT row_id, 'item_condition_id=' || item_condition_id::VARCHAR, 1.0 FROM cleaned
           UNION ALL SELECT row_id, 'shipping', shipping FROM cleaned"""
    ),
)
def onehot_features(spark, sf_dir):
    columns = X.dummies_bag(["category_name", "brand_name", "item_condition_id"], ["shipping"])
    return X.explode_bag(_clean(spark, sf_dir, False), columns)


@CATALOG.query(
    "word_ngrams",
    with_listings(
        "SELECT row_id, feature, count(*)::DOUBLE AS value FROM grams GROUP BY ALL",
        FILLED,
        grams("name", 2, "filled", words_without_stops("name")),
    ),
)
def word_ngrams(spark, sf_dir):
    rows = listings(spark, sf_dir, False)
    return X.explode_bag(rows, bag(X.ngram_tokens(F.col("name"), 1, 2)))


@CATALOG.query(
    "description_ngrams",
    with_listings(
        "SELECT row_id, feature, count(*)::DOUBLE AS value FROM grams GROUP BY ALL",
        FILLED,
        grams("item_description", 3, "filled", words_without_stops("item_description")),
    ).replace("coalesce(item_description, 'missvalue')", "coalesce(item_description, '')"),
)
def description_ngrams(spark, sf_dir):
    grams = Grams(X.kept_tokens(F.col("item_description")), (1.0, 1.0, 1.0))
    return X.explode_bag(with_grams(listings(spark, sf_dir), ["row_id"], grams=grams), F.col("grams"))


@CATALOG.query("hashed_ngrams")
def hashed_ngrams(spark, sf_dir):
    return X.hashed_features(listings(spark, sf_dir), X.kept_tokens(F.col("item_description")), 3, HASH_SLOTS)


WEIGHTS = {k: "CASE k " + " ".join(f"WHEN {i + 1} THEN {w!r}e0" for i, w in enumerate(v)) + " END"
           for k, v in {"name": NAME_NGRAM_WEIGHTS, "description": DESCRIPTION_NGRAM_WEIGHTS}.items()}


@CATALOG.query(
    "weighted_ngrams",
    with_cleaned(
        f"SELECT DISTINCT row_id, feature, round({WEIGHTS['name']}, 9) AS value FROM grams",
        grams("name", 2, "cleaned", space_words("name")),
    ),
)
def weighted_ngrams(spark, sf_dir):
    weighted = X.order_weighted_bag(F.col("name"), NAME_NGRAM_WEIGHTS, binary=True, normalize=False)
    return X.explode_bag(_clean(spark, sf_dir, False), weighted).withColumn("value", F.round("value", 9))


DESCRIBED = """described AS (SELECT row_id, split,
  CASE WHEN contains(category_name, '/') THEN trim(split_part(category_name, '/', 2)) ELSE 'missvalue' END
  || ' . . ' || name || ' . . ' || item_description AS item_description FROM cleaned)"""


@CATALOG.query(
    "weighted_description_ngrams",
    with_cleaned(
        f"""SELECT row_id, feature, round(v / sqrt(sum(v * v) OVER (PARTITION BY row_id)), 6) AS value
            FROM (SELECT row_id, feature, count(*) * {WEIGHTS['description']} AS v FROM grams GROUP BY row_id, k, feature)""",
        DESCRIBED,
        grams("item_description", 3, "described", space_words("item_description")),
    ),
)
def weighted_description_ngrams(spark, sf_dir):
    rows = separated_description(_clean(spark, sf_dir))
    weighted = Grams(X.space_tokens(F.col("item_description")), DESCRIPTION_NGRAM_WEIGHTS, normalize=True)
    return X.explode_bag(with_grams(rows, ["row_id"], grams=weighted), F.col("grams")).withColumn("value", F.round("value", 6))


@CATALOG.query(
    "document_frequency",
    with_cleaned("SELECT feature, count(*) AS df FROM counted GROUP BY ALL", counted("item_description")),
)
def document_frequency(spark, sf_dir):
    return X.document_frequency(_words(spark, sf_dir))


KEPT = "SELECT row_id, feature, value FROM counted WHERE feature IN (SELECT feature FROM counted GROUP BY feature HAVING "


@CATALOG.query(
    "df_filter",
    with_cleaned(
        KEPT + "count(*) >= 10 AND count(*) <= 0.5 * (SELECT count(*) FROM cleaned))",
        counted("item_description"),
    ),
)
def df_filter(spark, sf_dir):
    n_rows = _clean(spark, sf_dir, False).agg(F.count(F.lit(1))).scalar()
    return X.df_filter(_words(spark, sf_dir), 10, 0.5, n_rows)


@CATALOG.query(
    "train_df_filter",
    with_cleaned(
        f"""SELECT DISTINCT row_id, feature, round({WEIGHTS['name']}, 9) AS value FROM grams
            WHERE feature IN (SELECT feature FROM grams WHERE split = 'train' GROUP BY feature
                              HAVING count(DISTINCT row_id) > 2)""",
        grams("name", 2, "cleaned", space_words("name")),
    ),
)
def train_df_filter(spark, sf_dir):
    weighted = X.order_weighted_bag(F.col("name"), NAME_NGRAM_WEIGHTS, binary=True, normalize=False)
    features = X.explode_bag(_clean(spark, sf_dir, False), weighted, "split")
    return X.train_df_filter(features, k=2).select("row_id", "feature", F.round("value", 9).alias("value"))


@CATALOG.query(
    "features_in_both_splits",
    with_cleaned(
        KEPT + "count(*) FILTER (split = 'train') >= 1 AND count(*) FILTER (split = 'test') >= 1)",
        counted("item_description"),
    ),
)
def features_in_both_splits(spark, sf_dir):
    return X.features_in_both_splits(_words(spark, sf_dir, "split"), min_df=1).drop("split")


@CATALOG.query(
    "tfidf",
    with_cleaned(
        """SELECT row_id, feature, round(v / sqrt(sum(v * v) OVER (PARTITION BY row_id)), 6) AS value
           FROM (SELECT row_id, feature, value * (ln((1 + (SELECT count(*) FROM cleaned)) / (1 + df)) + 1) AS v
                 FROM counted JOIN (SELECT feature, count(*) AS df FROM counted GROUP BY feature) USING (feature))""",
        counted("item_description"),
    ),
)
def tfidf(spark, sf_dir):
    n_rows = _clean(spark, sf_dir, False).agg(F.count(F.lit(1))).scalar()
    return X.tfidf(_words(spark, sf_dir), n_rows).withColumn("value", F.round("value", 6))


PLAIN = f"""plain AS MATERIALIZED (
  SELECT row_id, split, {_units("lower(l.name)")} AS name, lower(coalesce(l.brand_name, '')) AS brand_name,
         (l.brand_name IS NOT NULL)::INTEGER AS has_brand, coalesce(l.shipping, 0) AS shipping,
         coalesce(l.item_condition_id, 1) AS item_condition_id,
         {_units("CASE WHEN l.item_description = 'No description yet' THEN '' ELSE lower(coalesce(l.item_description, '')) END")}
           AS item_description,
         general_cat, subcat_1, subcat_2, gen_subcat1
  FROM listings l JOIN levels USING (row_id))"""

LOWERED = f"""lowered AS MATERIALIZED (
  SELECT row_id, split, name || ' ' || c.brand_name AS name, c.brand_name, general_cat, subcat_1, subcat_2, gen_subcat1,
         has_brand, shipping, item_condition_id,
         item_description || ' ' || name || ' ' || c.brand_name || ' ' || subcat_1 || ' ' || subcat_2 || ' '
           || general_cat || ' ' || c.brand_name AS item_description
  FROM plain JOIN ({cascade_sql("plain")}) c USING (row_id))"""


def _gram_counts(column: str, orders: int) -> str:
    """Unit-length n-gram counts of one column of ``lowered``."""
    tokens = words_without_stops(column)
    parts = [
        f"""SELECT row_id, unnest(list_transform(range(1, len(w) - {k - 2}),
              lambda i: array_to_string(w[i:i + {k - 1}], ' '))) AS feature
            FROM (SELECT row_id, {tokens} AS w FROM lowered) WHERE len(w) >= {k}"""
        for k in range(1, orders + 1)
    ]
    return _unit(f"SELECT row_id, feature, count(*) AS c FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL", column)


def _unit(counts: str, block: str) -> str:
    return f"""SELECT row_id, '{block}' AS block, feature, c / sqrt(sum(c * c) OVER (PARTITION BY row_id)) AS value
               FROM ({counts})"""


def _whole(block: str, value: str) -> str:
    return f"SELECT row_id, '{block}' AS block, {value} AS feature, 1.0::DOUBLE AS value FROM lowered WHERE {value} <> ''"


UNION = "blocks AS MATERIALIZED (\n" + "\nUNION ALL ".join(
    [
        _gram_counts("name", 2),
        _unit(
            """SELECT row_id, feature, count(*) AS c
               FROM (SELECT row_id, unnest([general_cat, subcat_1, subcat_2, gen_subcat1]) AS feature FROM lowered)
               GROUP BY ALL""",
            "category_name",
        ),
        _whole("brand_name", "brand_name"),
        _whole("gencat_cond", "general_cat || '_' || item_condition_id::VARCHAR"),
        _whole("subcat_1_cond", "subcat_1 || '_' || item_condition_id::VARCHAR"),
        _whole("subcat_2_cond", "subcat_2 || '_' || item_condition_id::VARCHAR"),
        _whole("has_brand", "'has_brand=' || has_brand::VARCHAR"),
        _whole("shipping", "'shipping=' || shipping::VARCHAR"),
        _whole("item_condition_id", "'item_condition_id=' || item_condition_id::VARCHAR"),
        _gram_counts("item_description", 3),
    ]
) + ")"


@CATALOG.query(
    "feature_union",
    with_listings(
        """SELECT row_id, block || ':' || feature AS feature, round(value, 6) AS value
           FROM blocks JOIN (SELECT block, feature FROM blocks GROUP BY ALL HAVING count(*) >= 2) USING (block, feature)""",
        LEVELS_3,
        PLAIN,
        LOWERED,
        UNION,
    ),
)
def feature_union(spark, sf_dir):
    rows = listings(spark, sf_dir).fillna({"shipping": 0, "item_condition_id": 1})
    return tfidf_union(lowered_listings(rows)).withColumn("value", F.round("value", 6))


def _word_counts(block: str, column: str) -> str:
    return f"""SELECT row_id, '{block}:' || f, count(*)::DOUBLE
      FROM (SELECT row_id, unnest(regexp_extract_all(lower({column}), '{TOKEN}')) AS f FROM levelled) GROUP BY ALL"""


def _renamed(tables: str, block: str) -> str:
    """The common tables of n-grams under the names of one block."""
    return tables.replace("tokens", f"{block}_tokens").replace("grams AS", f"{block}_grams AS")


@CATALOG.query(
    "weighted_union",
    with_cleaned(
        f"""SELECT DISTINCT row_id, 'name:' || feature AS feature, round({WEIGHTS['name']}, 6) AS value FROM name_grams
           UNION ALL SELECT row_id, 'description:' || feature, round(v / sqrt(sum(v * v) OVER (PARTITION BY row_id)), 6)
             FROM (SELECT row_id, feature, count(*) * {WEIGHTS['description']} AS v FROM description_grams GROUP BY row_id, k, feature)
           UNION ALL {_word_counts('words_category_2', 'category_2')}
           UNION ALL {_word_counts('words_category_name', 'category_name')}
           UNION ALL {_word_counts('words_brand_name', 'brand_name')}
           UNION ALL SELECT row_id, 'onehot:category_1=' || category_1, 1.0 FROM levelled
           UNION ALL SELECT row_id, 'onehot:category_name=' || category_name, 1.0 FROM levelled
           UNION ALL SELECT row_id, 'onehot:brand_name=' || brand_name, 1.0 FROM levelled
           UNION ALL SELECT row_id, 'dummies:item_condition_id=' || item_condition_id::VARCHAR, 1.0 FROM levelled
           UNION ALL SELECT row_id, 'dummies:shipping', shipping FROM levelled""",
        """levelled AS MATERIALIZED (
             SELECT *, CASE WHEN contains(category_name, '/') THEN trim(split_part(category_name, '/', 1)) ELSE category_name END AS category_1,
                    CASE WHEN contains(category_name, '/') THEN trim(split_part(category_name, '/', 2)) ELSE 'missvalue' END AS category_2
             FROM cleaned)""",
        DESCRIBED,
        _renamed(grams("name", 2, "cleaned", space_words("name")), "name"),
        _renamed(grams("item_description", 3, "described", space_words("item_description")), "description"),
    ),
)
def weighted_union(spark, sf_dir):
    rows = separated_description(_clean(spark, sf_dir))
    return X.feature_union(*weighted_blocks(rows)).withColumn("value", F.round("value", 6))
