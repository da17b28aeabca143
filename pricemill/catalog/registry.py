"""Query registry and the SQL form of the views."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Catalog:
    queries: dict[str, Query] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def query(self, name: str, sql: str | None = None):
        """Register a query under ``name``; ``sql`` is the statement it must agree with."""

        def register(function: Query) -> Query:
            self.queries[name] = function
            if sql is not None:
                self.sql[name] = sql
            return function

        return register


CATALOG = Catalog()

# Character classes as in pricemill.functions.text; doubled backslashes are for Python only.
SPACE = "[\\t-\\r\\x{1c}-\\x{20}\\x{85}\\p{Z}]"


def tidy(text: str) -> str:
    return f"trim(regexp_replace({text}, '{SPACE}+', ' ', 'g'))"


def decimals(text: str) -> str:
    return f"regexp_replace({text}, '([0-9])( *)\\.( *)([0-9])', '\\1.\\4', 'g')"


def keep(text: str) -> str:
    apart = f"regexp_replace(lower({text}), '([a-z]+|[0-9]+)', ' \\1 ', 'g')"
    return tidy(decimals(apart))


def whitelist(text: str) -> str:
    kept = f"regexp_replace(lower({text}), '[^\\.!?@#&%$/\\\\0-9a-z]', ' ', 'g')"
    apart = f"regexp_replace({kept}, '(\\.|!|\\?|@|#|&|%|\\$|/|\\\\|[0-9]+)', ' \\1 ', 'g')"
    return tidy(decimals(apart))


LISTINGS = """listings AS (
  SELECT p_partkey AS row_id,
         CASE WHEN p_partkey % 4 < 3 THEN 'train' ELSE 'test' END AS split,
         CASE WHEN p_partkey % 3 = 0 THEN p_name || ' ' || p_brand ELSE p_name END AS name,
         CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_size % 5 + 1 END AS item_condition_id,
         CASE WHEN p_partkey % 4 = 3 AND p_partkey % 53 = 0 THEN 'New/Only/Test'
              WHEN p_partkey % 11 = 0 THEN NULL
              WHEN p_partkey % 7 = 0 THEN p_type
              ELSE p_type || '/S' || (p_size % 5)::VARCHAR || '/T' || p_size::VARCHAR END AS category_name,
         CASE WHEN p_partkey % 4 = 3 AND p_partkey % 59 = 0 THEN 'Unseen Brand'
              WHEN p_partkey % 5 = 0 THEN NULL ELSE p_brand END AS brand_name,
         CASE WHEN p_partkey % 4 = 3 THEN NULL WHEN p_partkey % 97 = 0 THEN 0.0::DOUBLE
              ELSE p_retailprice * (1 + p_size % 7) END AS price,
         CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE (p_partkey % 2)::INTEGER END AS shipping,
         CASE WHEN p_partkey % 13 = 0 THEN 'No description yet' WHEN p_partkey % 23 = 0 THEN NULL
              ELSE d.text END AS item_description
  FROM part LEFT JOIN documents d ON d.doc_id = p_partkey % (SELECT count(*) FROM documents))"""

FILLED = """filled AS (
  SELECT row_id, split, price,
         coalesce(name, 'missvalue') AS name,
         coalesce(category_name, 'missvalue') AS category_name,
         coalesce(brand_name, 'missvalue') AS brand_name,
         coalesce(item_description, 'missvalue') AS item_description,
         coalesce(item_condition_id, 1)::INTEGER AS item_condition_id,
         coalesce(shipping, 0)::INTEGER AS shipping
  FROM listings)"""

CLEANED = f"""cleaned AS MATERIALIZED (
  SELECT row_id, split, price, item_condition_id, shipping,
         {keep('name')} AS name, {keep('item_description')} AS item_description,
         {whitelist('brand_name')} AS brand_name, {whitelist('category_name')} AS category_name
  FROM filled WHERE price IS DISTINCT FROM 0)"""

PREDICTIONS = """priced AS (SELECT * FROM listings WHERE split = 'train' AND price > 0),
actuals AS (SELECT row_id, (row_id % 5)::INTEGER AS fold, ln(1 + price) AS y FROM priced),
snapshots AS (
  SELECT row_id, model, snapshot,
         ln(1 + price) + (((row_id * k) % 101 - 50) / 500.0 + snapshot / 1000.0) AS pred
  FROM priced, (VALUES ('a', 7), ('b', 13), ('c', 29)) m(model, k), (VALUES (0), (1), (2)) s(snapshot)),
predictions AS (SELECT row_id, model, pred FROM snapshots WHERE snapshot = 0)"""


def with_listings(body: str, *more: str) -> str:
    """``WITH`` clause of the listings view and further common tables, then ``body``."""
    return "WITH " + ",\n".join([LISTINGS, *more]) + "\n" + body


def with_cleaned(body: str, *more: str) -> str:
    return with_listings(body, FILLED, CLEANED, *more)
