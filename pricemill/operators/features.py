"""Sparse features as a long table ``(row_id, feature, value)``.

Vectorising is row-local: tokens, n-grams, counts and norms are array expressions over one row, so
no shuffle happens before features of different rows must meet. Every (row, feature) pair occurs
once, so a plain count per feature is its document frequency.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from pricemill.constants import STOP_WORDS
from pricemill.functions.sequences import (
    bag,
    concat_bags,
    hash_slot,
    prefixed,
    remove_words,
    run_lengths,
    single,
    weighted_ngram_bag,
    word_ngrams,
)
from pricemill.functions.text import find_tokens
from pricemill.operators.grams import Grams, with_grams, with_slots
from pricemill.operators.joins import BROADCAST_CHARACTERS, BROADCAST_ROWS, HOT_SHARE
from pricemill.session import stage


def explode_bag(df: DataFrame, bag_column: Column, *keep: str) -> DataFrame:
    """``(row_id, ..., feature, value)`` rows of a bag column."""
    return df.select("row_id", *keep, F.inline(bag_column))


def count_bag(text: Column) -> Column:
    """Counts of the lower-cased words of two or more characters."""
    return bag(find_tokens(F.lower(text)))


def ngram_tokens(text: Column, low: int, high: int, stop_words=STOP_WORDS) -> Column:
    """N-grams of a text whose case is kept; stop words leave before n-grams are formed."""
    return word_ngrams(remove_words(find_tokens(text), stop_words), low, high)


def hashed_features(df: DataFrame, words: Column, orders: int, slots: int, normalize: bool = True) -> DataFrame:
    """Counts of n-grams per hash slot; n-grams that share a slot are summed."""
    counted = with_grams(df, ["row_id"], grams=Grams(words, [1.0] * orders))
    summed = with_slots(counted, ["row_id"], F.col("grams"), lambda gram: hash_slot(gram, slots).cast("int"), normalize)
    entries = summed.select("row_id", F.inline(F.arrays_zip("slots", "weights")))
    return entries.select("row_id", F.col("slots").cast("string").alias("feature"), F.col("weights").alias("value"))


def space_tokens(text: Column) -> Column:
    return F.filter(F.split(text, " ", -1), lambda t: t != "")


def kept_tokens(text: Column, stop_words=STOP_WORDS) -> Column:
    """The tokens of a text whose case is kept, without stop words."""
    return remove_words(find_tokens(text), stop_words)


def order_weighted_bag(text: Column, weights, binary: bool, normalize: bool) -> Column:
    """Order-weighted n-grams of the space-separated words. ``binary`` counts a repeated n-gram
    once; otherwise the count multiplies the weight of its order."""
    return weighted_ngram_bag(space_tokens(text), weights, binary, normalize)


def onehot_bag(columns: list[str]) -> Column:
    """``column=value`` with value one for each categorical column."""
    return concat_bags(
        *[single(F.concat(F.lit(c + "="), F.col(c).cast("string"))) for c in columns]
    )


def dummies_bag(categorical: list[str], numeric: list[str]) -> Column:
    """Categories expand to ``column=value``; numbers pass through under their own name."""
    numbers = [single(F.lit(c), F.col(c)) for c in numeric]
    return concat_bags(onehot_bag(categorical), *numbers)


def feature_union(df: DataFrame, blocks: Mapping[str, Column]) -> DataFrame:
    """One long table of all blocks, features named ``block:feature``: the bags are joined inside
    the row, so the input is scanned once however many blocks there are."""
    return explode_bag(df, concat_bags(*[prefixed(b, name) for name, b in blocks.items()]))


def document_frequency(features: DataFrame) -> DataFrame:
    """``(feature, df)``: rows that have the feature."""
    return features.groupBy("feature").agg(F.count(F.lit(1)).alias("df"))


def keyed_features(features: DataFrame) -> DataFrame:
    """The features, staged, with a 64-bit ``key`` of their names: they are counted, then read again. Names of n-grams repeat their words
    and are packed close; keys would not be, so they are made anew by each reader."""
    return stage(features, "features", compression="zstd").withColumn("key", F.xxhash64("feature"))


def feature_dictionary(keyed: DataFrame) -> DataFrame:
    """``(key, feature, df)``, with ``train`` and ``test`` if there is a split: each name once, staged.

    Rows are moved by keys alone, and names come back from here; two names with one key (a chance of
    one in thirty thousand among a billion names) are an error.
    """
    by_split = [F.count_if(F.col("split") == s).alias(s) for s in ("train", "test") if "split" in keyed.columns]
    names = stage(keyed.groupBy("key", "feature").agg(F.count(F.lit(1)).alias("df"), *by_split), "feature-dictionary", compression="zstd")
    if not names.groupBy("key").count().where("count > 1").isEmpty():
        raise ValueError("two features have one key")
    return names


def frequent_from(dictionary: DataFrame) -> int:
    """The document frequency from which on features are answered by a broadcast: of the powers of two the least one that
    keeps within the broadcast bounds, or the frequency above which there are fewer than 1000 features, if that is less."""
    level = F.floor(F.log2("df")).cast("int").alias("level")
    sizes = dictionary.groupBy(level).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("feature")).alias("c"), F.sum("df").alias("df")).collect()
    least, rows, characters = 2**62, 0, 0
    for size in sorted(sizes, key=lambda s: -s["level"]):
        rows, characters = rows + size["n"], characters + size["c"]
        if rows > BROADCAST_ROWS or characters > BROADCAST_CHARACTERS:
            break
        least = 2 ** size["level"]
    return min(least, sum(size["df"] for size in sizes) // HOT_SHARE + 1)


def with_entries(keyed: DataFrame, dictionary: DataFrame, kept: Column, **values: Column) -> DataFrame:
    """The rows whose feature is ``kept`` (a condition on the dictionary), with ``values`` computed there.

    The most frequent features, which hold most of the rows, are answered by a bounded broadcast. The
    others' rows meet the dictionary on their keys, shuffled without names; if none of those is kept, they are not read.
    """
    hot = F.col("df") >= frequent_from(dictionary)
    entries = lambda where: dictionary.where(where).select("key", "feature", *[v.alias(k) for k, v in values.items()])
    rows = keyed.drop("feature")
    columns = [*[c for c in keyed.columns if c != "key"], *values]
    near = rows.join(F.broadcast(entries(kept & hot)), "key").select(*columns)
    cold = entries(kept & ~hot)
    if cold.isEmpty():
        return near
    rest = rows.join(F.broadcast(dictionary.where(hot).select("key")), "key", "left_anti")
    return near.unionByName(rest.join(cold, "key").select(*columns))


def df_filter(features: DataFrame, min_df: int = 1, max_df: float = 1.0, n_rows: Column | None = None) -> DataFrame:
    """Features in at least ``min_df`` rows and, if ``max_df < 1``, in at most that share of them."""
    keyed = keyed_features(features)
    kept = F.col("df") >= min_df
    if max_df < 1.0:
        total = keyed.agg(F.count_distinct("row_id")).scalar() if n_rows is None else n_rows
        kept = kept & (F.col("df") <= total * F.lit(max_df))
    return with_entries(keyed, feature_dictionary(keyed), kept)


def train_df_filter(features: DataFrame, k: int) -> DataFrame:
    """Features in more than ``k`` train rows, kept for all rows. ``features`` has ``split``."""
    keyed = keyed_features(features)
    return with_entries(keyed, feature_dictionary(keyed), F.col("train") > k)


def features_in_both_splits(features: DataFrame, min_df: int = 1) -> DataFrame:
    """Features in at least ``min_df`` train rows and as many test rows."""
    keyed = keyed_features(features)
    return with_entries(keyed, feature_dictionary(keyed), (F.col("train") >= min_df) & (F.col("test") >= min_df))


def whole_value_onehot(df: DataFrame, column: str, min_df: int = 2) -> DataFrame:
    """The whole value as one feature, for values of at least ``min_df`` rows."""
    features = explode_bag(df.where(F.col(column) != ""), single(F.col(column)))
    return df_filter(features, min_df)


def l2_normalize_rows(features: DataFrame) -> DataFrame:
    """Divide by the row norm; rows of one id meet once, sorted and spillable."""
    norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy("row_id")))
    return features.withColumn("value", F.col("value") / norm)


def tfidf(features: DataFrame, n_rows: Column) -> DataFrame:
    """Smooth inverse document frequency ``ln((1 + n) / (1 + df)) + 1`` times the value, then the
    row norm. ``n_rows`` counts all rows, with or without features."""
    keyed = keyed_features(features)
    idf = F.log((F.lit(1) + n_rows) / (F.lit(1) + F.col("df"))) + 1
    weighted = with_entries(keyed, feature_dictionary(keyed), F.lit(True), _idf=idf)
    scaled = weighted.withColumn("value", F.col("value") * F.col("_idf")).drop("_idf")
    return l2_normalize_rows(scaled).select(*features.columns)
