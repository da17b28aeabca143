"""Text cleaning, splitting, overlap and target transforms."""

from pyspark.sql import functions as F

from pricemill.catalog.brands import cascade_sql
from pricemill.catalog.registry import (
    CATALOG, FILLED, SPACE, decimals, keep, tidy, whitelist, with_cleaned, with_listings,
)
from pricemill.functions import text as T
from pricemill.functions.numeric import target_to_price
from pricemill.operators.encode import fill_missing
from pricemill.operators.scale import normalize_target
from pricemill.plans.cleaning import clean_listings, lowered_listings, separated_description
from pricemill.sources import listings


def _cleaned(expression: str, column: str = "item_description") -> str:
    return with_listings(f"SELECT row_id, {expression} AS {column} FROM filled", FILLED)


def _apply(function, column="item_description"):
    def run(spark, sf_dir):
        rows = fill_missing(listings(spark, sf_dir, column == "item_description"))
        return rows.select("row_id", function(F.col(column)).alias(column))

    return run


def _runs(text: str, drop: str, isolate: str) -> str:
    kept = f"regexp_replace(lower({text}), '{drop}', ' ', 'g')" if drop else f"lower({text})"
    return f"regexp_replace({kept}, '{isolate}', ' \\1 ', 'g')"


CATALOG.query("clean_text_keep", _cleaned(keep("item_description")))(_apply(T.clean_keep))
CATALOG.query("clean_text_whitelist", _cleaned(whitelist("item_description")))(_apply(T.clean_whitelist))
CATALOG.query(
    "clean_text_small",
    _cleaned(tidy(decimals(_runs("item_description", "[^\\.&%$0-9a-z]", "(\\.|&|%|[0-9]+)")))),
)(_apply(T.clean_small))
CATALOG.query(
    "clean_text_path", _cleaned(tidy(_runs("category_name", "[^0-9a-z&/]", "(&|/|[0-9]+)")), "category_name")
)(_apply(T.clean_path, "category_name"))
CATALOG.query(
    "clean_text_symbols",
    _cleaned(tidy(decimals(_runs("item_description", "", "([a-z]+|[0-9]+|[^0-9a-z])")))),
)(_apply(T.clean_symbols))


@CATALOG.query(
    "clean_listings",
    with_cleaned(
        """SELECT row_id, split, price, item_condition_id, shipping, name, item_description, brand_name,
                  category_name, trim(split_part(category_name, '/', 1)) AS category_1,
                  CASE WHEN contains(category_name, '/') THEN trim(split_part(category_name, '/', 2))
                       ELSE 'missvalue' END AS category_2
           FROM cleaned"""
    ),
)
def clean_listings_query(spark, sf_dir):
    return clean_listings(listings(spark, sf_dir))


@CATALOG.query(
    "split_category_2",
    with_listings(
        """SELECT row_id, trim(split_part(category_name, '/', 1)) AS category_1,
                  CASE WHEN contains(category_name, '/') THEN trim(split_part(category_name, '/', 2))
                       ELSE 'missvalue' END AS category_2 FROM filled""",
        FILLED,
    ),
)
def split_category_2(spark, sf_dir):
    first, second = T.category_levels_2(F.col("category_name"))
    rows = fill_missing(listings(spark, sf_dir, False))
    return rows.select("row_id", first.alias("category_1"), second.alias("category_2"))


LEVELS_3 = """levels AS (
  SELECT row_id, item_condition_id, c AS category_name,
         CASE WHEN len(p) >= 3 THEN p[1] ELSE 'other' END AS general_cat,
         CASE WHEN len(p) >= 3 THEN p[2] ELSE 'other' END AS subcat_1,
         CASE WHEN len(p) >= 3 THEN p[3] ELSE 'other' END AS subcat_2,
         CASE WHEN len(p) >= 3 THEN p[1] || '/' || p[2] ELSE 'other/other' END AS gen_subcat1
  FROM (SELECT row_id, item_condition_id, lower(coalesce(category_name, 'other/other/other')) AS c,
               string_split(c, '/') AS p FROM listings))"""


@CATALOG.query(
    "split_category_3",
    with_listings(
        "SELECT row_id, category_name, general_cat, subcat_1, subcat_2, gen_subcat1 FROM levels", LEVELS_3
    ),
)
def split_category_3(spark, sf_dir):
    path = F.lower(F.coalesce("category_name", F.lit("other/other/other")))
    rows = listings(spark, sf_dir, False).select("row_id", path.alias("category_name"))
    return rows.withColumns(T.category_levels_3(F.col("category_name")))


@CATALOG.query(
    "cross_keys",
    with_listings(
        """SELECT row_id, general_cat || '_' || i::VARCHAR AS gencat_cond, subcat_1 || '_' || i::VARCHAR AS subcat_1_cond,
                  subcat_2 || '_' || i::VARCHAR AS subcat_2_cond
           FROM (SELECT *, coalesce(item_condition_id, 1) AS i FROM levels)""",
        LEVELS_3,
    ),
)
def cross_keys(spark, sf_dir):
    rows = fill_missing(listings(spark, sf_dir, False), text_columns=())
    path = F.lower(F.coalesce("category_name", F.lit("other/other/other")))
    levels = T.category_levels_3(path)
    condition = F.col("item_condition_id")
    return rows.select(
        "row_id",
        T.cross_key(levels["general_cat"], condition).alias("gencat_cond"),
        T.cross_key(levels["subcat_1"], condition).alias("subcat_1_cond"),
        T.cross_key(levels["subcat_2"], condition).alias("subcat_2_cond"),
    )


@CATALOG.query(
    "word_length",
    with_cleaned("SELECT row_id, len(string_split(item_description, ' '))::INTEGER AS word_len FROM cleaned"),
)
def word_length_query(spark, sf_dir):
    cleaned = clean_listings(listings(spark, sf_dir))
    return cleaned.select("row_id", T.word_length(F.col("item_description")).alias("word_len"))


def _units(text: str) -> str:
    karats = (
        f"regexp_replace({text}, '(\\p{{Nd}})({SPACE[:-1]}-]?)(karat|karats|carat|carats|kt)([^\\p{{L}}\\p{{N}}_])', "
        "'\\1k\\4', 'g')"
    )
    return f"regexp_replace({karats}, '(\\p{{Nd}}+){SPACE[:-1]}-]([a-z]{{2}})({SPACE})', '\\1\\2\\3', 'g')"


@CATALOG.query(
    "normalize_units",
    with_listings(
        f"""SELECT row_id, {_units("lower(name) || ' ' || row_id::VARCHAR || ' ' || CASE row_id % 3 WHEN 0 THEN 'karat ' WHEN 1 THEN 'kt gold ' ELSE 'oz cup ' END || lower(item_description)")} AS item_description
            FROM filled""",
        FILLED,
    ),
)
def normalize_units_query(spark, sf_dir):
    # the given texts hold few units, so each row gets one between its name and its description
    unit = (
        F.when(F.col("row_id") % 3 == 0, "karat ").when(F.col("row_id") % 3 == 1, "kt gold ").otherwise("oz cup ")
    )
    text = F.concat(
        F.lower("name"), F.lit(" "), F.col("row_id").cast("string"), F.lit(" "), unit, F.lower("item_description")
    )
    rows = fill_missing(listings(spark, sf_dir))
    return rows.select("row_id", T.normalize_units(text).alias("item_description"))


@CATALOG.query(
    "token_overlap",
    with_cleaned(
        """SELECT row_id,
             round(len(list_intersect(b, string_split(name, ' '))) / (len(list_distinct(b)) + 1), 9) AS brand_name_name_intsct,
             round(len(list_intersect(b, string_split(item_description, ' '))) / (len(list_distinct(b)) + 1), 9)
               AS brand_name_item_description_intsct
           FROM (SELECT *, string_split(brand_name, ' ') AS b FROM cleaned)"""
    ),
)
def token_overlap_query(spark, sf_dir):
    cleaned = clean_listings(listings(spark, sf_dir))
    return cleaned.select(
        "row_id",
        *[
            F.round(T.token_overlap(F.col("brand_name"), F.col(c)), 9).alias(f"brand_name_{c}_intsct")
            for c in ("name", "item_description")
        ],
    )


@CATALOG.query(
    "separated_description",
    with_cleaned(
        """SELECT row_id, CASE WHEN contains(category_name, '/') THEN trim(split_part(category_name, '/', 2))
                               ELSE 'missvalue' END || ' . . ' || name || ' . . ' || item_description AS item_description
           FROM cleaned"""
    ),
)
def separated_description_query(spark, sf_dir):
    rows = separated_description(clean_listings(listings(spark, sf_dir)))
    return rows.select("row_id", "item_description")


@CATALOG.query(
    "lowered_listings",
    with_listings(
        f"""SELECT row_id, has_category, has_brand, name || ' ' || c.brand_name AS name,
                   item_description || ' ' || name || ' ' || c.brand_name || ' ' || subcat_1 || ' ' || subcat_2 || ' '
                     || general_cat || ' ' || c.brand_name AS item_description
            FROM plain JOIN ({cascade_sql("plain")}) c USING (row_id)""",
        LEVELS_3,
        f"""plain AS MATERIALIZED (
              SELECT l.row_id, (l.category_name IS NOT NULL)::INTEGER AS has_category,
                     (l.brand_name IS NOT NULL)::INTEGER AS has_brand,
                     {_units("lower(coalesce(l.name, ''))")} AS name, lower(coalesce(l.brand_name, '')) AS brand_name,
                     {_units("CASE WHEN l.item_description = 'No description yet' THEN '' ELSE lower(coalesce(l.item_description, '')) END")}
                       AS item_description,
                     subcat_1, subcat_2, general_cat
              FROM listings l JOIN levels USING (row_id))""",
    ),
)
def lowered_listings_query(spark, sf_dir):
    rows = lowered_listings(listings(spark, sf_dir))
    return rows.select("row_id", "has_category", "has_brand", "name", "item_description")


@CATALOG.query(
    "normalize_target",
    with_listings(
        """SELECT row_id, round((ln(1 + price) - (SELECT avg(ln(1 + price)) FROM t))
                                / (SELECT stddev_pop(ln(1 + price)) FROM t), 6) AS target FROM t""",
        "t AS (SELECT row_id, price FROM listings WHERE price > 0)",
    ),
)
def normalize_target_query(spark, sf_dir):
    rows = listings(spark, sf_dir, False).where("price > 0").select("row_id", "price")
    return normalize_target(rows).select("row_id", F.round("target", 6).alias("target"))


@CATALOG.query(
    "inverse_target",
    with_listings(
        """SELECT row_id, round(least(greatest(exp(z * 0.7459273872548303 + 2.98081628517) - 1, 3.0), 2000.0), 6) AS price
           FROM (SELECT row_id, (ln(1 + price) - 2.98081628517) / 0.7459273872548303 + (row_id % 9 - 4) AS z
                 FROM listings WHERE price > 0)"""
    ),
)
def inverse_target_query(spark, sf_dir):
    from pricemill.constants import ORIGINAL_TARGET_MEAN, ORIGINAL_TARGET_STD, PRICE_CEILING, PRICE_FLOOR

    rows = listings(spark, sf_dir, False).where("price > 0")
    scaled = normalize_target(rows, mean=ORIGINAL_TARGET_MEAN, std=ORIGINAL_TARGET_STD)
    moved = F.col("target") + (F.col("row_id") % 9 - 4)
    price = target_to_price(moved, ORIGINAL_TARGET_MEAN, ORIGINAL_TARGET_STD, PRICE_FLOOR, PRICE_CEILING)
    return scaled.select("row_id", F.round(price, 6).alias("price"))
