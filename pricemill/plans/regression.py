"""Listings to prices: the TF-IDF ridge, and the blend of several learners."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Model
from pyspark.sql import DataFrame, functions as F

from pricemill.constants import (
    FM_FACTORS,
    PRICE_CEILING,
    PRICE_FLOOR,
    RIDGE_MAX_ITER,
    RIDGE_TOLERANCE,
    VOCABULARY_SIZE,
)
from pricemill.functions.numeric import target_to_price
from pricemill.functions.sequences import concat_bags, prefixed
from pricemill.operators import models as M
from pricemill.operators.encode import mask_unseen, word_index
from pricemill.operators.evaluate import weighted_blend
from pricemill.operators.grams import PACKED_OPTIONS
from pricemill.plans.blocks import tfidf_grams, tfidf_values, weighted_grams, weighted_values
from pricemill.plans.cleaning import clean_listings, lowered_listings, separated_description
from pricemill.plans.hand_features import HAND_FEATURES, hand_features


def all_blocks(blocks):
    """One bag of all blocks, features named ``block:feature``."""
    return concat_bags(*[prefixed(b, name) for name, b in blocks.items()])


def with_target(rows: DataFrame) -> DataFrame:
    """Add ``target = log1p(price)`` (null for test rows)."""
    return rows.withColumn("target", F.log1p("price"))


def tfidf_rows(raw: DataFrame, slots: int = M.MODEL_SLOTS, impute: bool = True) -> DataFrame:
    """TF-IDF vectors of priced train rows and all test rows, over slots of both splits, staged for the fit."""
    priced = raw.where((F.col("split") == "test") | (F.col("price") > 0))
    rows = with_target(lowered_listings(priced.fillna({"shipping": 0, "item_condition_id": 1}), impute))
    hashed = M.stage(M.hashed_grams(rows, tfidf_grams(), all_blocks(tfidf_values()), slots))
    return M.stage(M.on_slots(hashed, M.tfidf_slots(hashed)))


def packed_tfidf(raw: DataFrame, slots: int = M.MODEL_SLOTS, impute: bool = True) -> DataFrame:
    """The features of :func:`tfidf_rows` before they are weighted, as packed rows, staged."""
    priced = raw.where((F.col("split") == "test") | (F.col("price") > 0))
    rows = with_target(lowered_listings(priced.fillna({"shipping": 0, "item_condition_id": 1}), impute))
    return M.stage(M.hashed_grams(rows, tfidf_grams(), all_blocks(tfidf_values()), slots, packed=True), "packed", **PACKED_OPTIONS)


def ridge_prices(
    raw: DataFrame,
    slots: int = M.MODEL_SLOTS,
    max_iter: int = RIDGE_MAX_ITER,
    tol: float = RIDGE_TOLERANCE,
) -> DataFrame:
    """``(row_id, price)`` of the test rows by ridge regression on TF-IDF features."""
    rows = packed_tfidf(raw, slots)
    penalty, none = M.ridge_penalty_of(max_iter=max_iter, tol=tol), np.zeros(slots)
    predictions = M.linear_predictions(rows, {"ridge": penalty}, none, M.tfidf_weighting(rows, slots))
    return predictions.select("row_id", target_to_price(F.col("pred"), floor=0.0).alias("price"))


def weighted_slots(raw: DataFrame, slots: int = M.MODEL_SLOTS) -> DataFrame:
    """Order-weighted features of all rows in their slots, staged."""
    cleaned = separated_description(clean_listings(raw))
    known = mask_unseen(mask_unseen(cleaned, "category_name"), "brand_name")
    return M.stage(M.hashed_grams(with_target(known), weighted_grams(), all_blocks(weighted_values()), slots, apart=True))


def packed_weighted(raw: DataFrame, slots: int = M.MODEL_SLOTS) -> DataFrame:
    """:func:`weighted_slots` as packed rows."""
    cleaned = separated_description(clean_listings(raw))
    known = mask_unseen(mask_unseen(cleaned, "category_name"), "brand_name")
    return M.stage(M.hashed_grams(with_target(known), weighted_grams(), all_blocks(weighted_values()), slots, apart=True, packed=True), "packed", **PACKED_OPTIONS)


def weighted_rows(raw: DataFrame, slots: int = M.MODEL_SLOTS) -> DataFrame:
    """Order-weighted vectors of all rows over the slots that enough training rows use, staged."""
    hashed = weighted_slots(raw, slots)
    # staged again: a fit runs many short jobs, and each would ship the whole plan with its dictionary
    return M.stage(M.on_slots(hashed, M.train_slots(hashed, M.block_least(slots))))


def pooled_rows(raw: DataFrame, vocabulary: int = VOCABULARY_SIZE) -> DataFrame:
    """Known words of name and description with hand features and target, staged."""
    cleaned = with_target(clean_listings(raw))
    train = cleaned.where("split = 'train'")
    indices = {c: word_index(train, c, vocabulary) for c in ("name", "item_description")}
    words = M.known_words(cleaned, indices, ("row_id", "target", "shipping", "item_condition_id"))
    return M.stage(hand_features(cleaned).join(words, "row_id"))


def fit_pooled_embedding(rows: DataFrame, size: int = 32, max_iter: int = 3) -> Model:
    train = rows.where("split = 'train'")
    partitions = train.sparkSession.sparkContext.defaultParallelism
    numbers = [*HAND_FEATURES, "shipping", "item_condition_id"]
    return M.pooled_embedding_pipeline(
        ["name", "item_description"], numbers, size, partitions, max_iter
    ).fit(train)


def blended_prices(
    raw: DataFrame,
    weights: dict[str, float],
    slots: int = M.MODEL_SLOTS,
    factors: int = FM_FACTORS,
    vector_size: int = 32,
    max_iter: int = 50,
) -> DataFrame:
    """``(row_id, price)`` of the test rows: a linear learner, a factorisation machine and pooled
    embeddings, blended on the log scale, taken back to prices and clamped."""
    sparse, pooled = weighted_rows(raw, slots), pooled_rows(raw)
    train, test = sparse.where("split = 'train'"), sparse.where("split = 'test'")
    linear, factorisation, embedding = M.side_by_side([
        lambda: M.predict(M.fit_elastic_net(train, max_iter=max_iter), test, "linear"),
        lambda: M.predict(M.fit_factorisation_machine(train, factors), test, "factorisation"),
        lambda: M.predict(fit_pooled_embedding(pooled, vector_size), pooled.where("split = 'test'"), "embedding"),
    ])
    predictions = linear.unionByName(factorisation).unionByName(embedding)
    blend = weighted_blend(predictions, weights)
    price = target_to_price(F.col("pred"), floor=PRICE_FLOOR, ceiling=PRICE_CEILING)
    return blend.select("row_id", price.alias("price"))
