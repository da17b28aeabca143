"""Errors, blends and weight search over deterministic predictions."""

from pyspark.sql import functions as F

from pricemill.catalog.registry import CATALOG, PREDICTIONS, with_cleaned, with_listings
from pricemill.constants import PRICE_CEILING, PRICE_FLOOR, SNAPSHOT_DIVISOR, SNAPSHOT_WEIGHTS
from pricemill.functions.numeric import target_to_price
from pricemill.functions.text import word_length
from pricemill.operators import evaluate as V
from pricemill.plans.cleaning import clean_listings
from pricemill.sources import actuals, listings, predictions

MODELS = ["a", "b", "c"]
BLEND = {"a": 0.6, "b": 0.7, "c": 1.15}
STEPS = 10


def _with_predictions(body: str, *more: str) -> str:
    return with_listings(body, PREDICTIONS, *more)


def _predictions(spark, sf_dir):
    return predictions(spark, sf_dir).select("row_id", "model", "pred")


FOLD_RMSE = """fold_rmse AS (
  SELECT model, fold, sqrt(avg((pred - y) ** 2)) AS rmse FROM predictions JOIN actuals USING (row_id) GROUP BY ALL)"""


@CATALOG.query(
    "rmse_by_fold", _with_predictions("SELECT model, fold, round(rmse, 9) AS rmse FROM fold_rmse", FOLD_RMSE)
)
def rmse_by_fold(spark, sf_dir):
    scores = V.rmse_by_fold(_predictions(spark, sf_dir), actuals(spark, sf_dir))
    return scores.withColumn("rmse", F.round("rmse", 9))


@CATALOG.query(
    "rmsle",
    _with_predictions(
        """SELECT model, round(sqrt(avg((ln(1 + (exp(pred) - 1)) - ln(1 + (exp(y) - 1))) ** 2)), 9) AS rmsle
           FROM predictions JOIN actuals USING (row_id) GROUP BY model"""
    ),
)
def rmsle(spark, sf_dir):
    scored = V.with_actuals(_predictions(spark, sf_dir), actuals(spark, sf_dir))
    return scored.groupBy("model").agg(F.round(V.rmsle(F.col("pred"), F.col("y")), 9).alias("rmsle"))


@CATALOG.query(
    "cv_summary",
    _with_predictions(
        """SELECT model, round(avg(rmse), 9) AS mean_rmse, round(stddev_pop(rmse), 9) AS std_rmse
           FROM fold_rmse GROUP BY model""",
        FOLD_RMSE,
    ),
)
def cv_summary(spark, sf_dir):
    summary = V.cv_summary(V.rmse_by_fold(_predictions(spark, sf_dir), actuals(spark, sf_dir)))
    return summary.select("model", *[F.round(c, 9).alias(c) for c in ("mean_rmse", "std_rmse")])


@CATALOG.query(
    "feature_correlation",
    with_cleaned(
        """SELECT round(corr(len(string_split(item_description, ' ')), price), 6) AS word_len_price,
                  round(corr(shipping, price), 6) AS shipping_price, 0.0::DOUBLE AS constant_price
           FROM cleaned WHERE price IS NOT NULL"""
    ),
)
def feature_correlation(spark, sf_dir):
    rows = clean_listings(listings(spark, sf_dir)).where(F.col("price").isNotNull())
    measured = rows.select(
        word_length(F.col("item_description")).alias("word_len"), "shipping", F.lit(1.0).alias("constant"), "price"
    )
    return measured.agg(
        F.round(V.correlation("word_len", "price"), 6).alias("word_len_price"),
        F.round(V.correlation("shipping", "price"), 6).alias("shipping_price"),
        F.round(V.correlation("constant", "price"), 6).alias("constant_price"),
    )


@CATALOG.query(
    "worst_predictions",
    _with_predictions(
        """SELECT p.row_id, name, brand_name, l.price, round(exp(pred) - 1, 6) AS pred_price, round(abs(pred - y), 6) AS error
           FROM predictions p JOIN actuals a USING (row_id) JOIN listings l USING (row_id) WHERE model = 'b'
           ORDER BY abs(round(pred - y, 9)) DESC, p.row_id LIMIT 50"""
    ),
)
def worst_predictions(spark, sf_dir):
    scored = V.with_actuals(_predictions(spark, sf_dir).where("model = 'b'"), actuals(spark, sf_dir))
    # equal errors differ in the last bit; rounding makes them ties, which the id then decides
    error = F.round(F.col("pred") - F.col("y"), 9)
    worst = V.worst_predictions(scored, 50, error=error)
    shown = worst.join(listings(spark, sf_dir, False).drop("split"), "row_id")
    return shown.select(
        "row_id", "name", "brand_name", "price",
        F.round(target_to_price(F.col("pred")), 6).alias("pred_price"),
        F.round(F.abs(F.col("pred") - F.col("y")), 6).alias("error"),
    )


WEIGHT = "CASE model WHEN 'a' THEN 0.6e0 WHEN 'b' THEN 0.7e0 ELSE 1.15e0 END"
BLENDED = f"""blended AS (
  SELECT row_id, sum(pred * {WEIGHT}) / sum({WEIGHT}) AS pred FROM predictions GROUP BY row_id)"""


@CATALOG.query(
    "weighted_blend", _with_predictions("SELECT row_id, round(pred, 9) AS pred FROM blended", BLENDED)
)
def weighted_blend(spark, sf_dir):
    return V.weighted_blend(_predictions(spark, sf_dir), BLEND).withColumn("pred", F.round("pred", 9))


@CATALOG.query(
    "snapshot_average",
    _with_predictions(
        """SELECT row_id, model, round(sum(pred * CASE snapshot WHEN 0 THEN 0.8e0 WHEN 1 THEN 1.0e0 ELSE 1.2e0 END) / 3.0e0, 9)
             AS pred FROM snapshots GROUP BY ALL"""
    ),
)
def snapshot_average(spark, sf_dir):
    averaged = V.snapshot_average(predictions(spark, sf_dir, snapshots=3), SNAPSHOT_WEIGHTS, SNAPSHOT_DIVISOR)
    return averaged.withColumn("pred", F.round("pred", 9))


@CATALOG.query(
    "prediction_summary",
    _with_predictions(
        """SELECT round(avg(p), 6) AS mean_price, round(avg(least(greatest(p, 3.0), 2000.0)), 6) AS mean_clamped, count(*) AS n
           FROM (SELECT exp(pred) - 1 AS p FROM blended)""",
        BLENDED,
    ),
)
def prediction_summary(spark, sf_dir):
    blend = V.weighted_blend(_predictions(spark, sf_dir), BLEND)
    clamped = target_to_price(F.col("pred"), floor=PRICE_FLOOR, ceiling=PRICE_CEILING)
    return blend.agg(
        F.round(F.avg(target_to_price(F.col("pred"))), 6).alias("mean_price"),
        F.round(F.avg(clamped), 6).alias("mean_clamped"),
        F.count(F.lit(1)).alias("n"),
    )


OOF = """oof AS (
  SELECT row_id, fold, y, max(pred) FILTER (model = 'a') AS a, max(pred) FILTER (model = 'b') AS b,
         max(pred) FILTER (model = 'c') AS c
  FROM predictions JOIN actuals USING (row_id) GROUP BY ALL)"""


@CATALOG.query(
    "oof_table",
    _with_predictions(
        "SELECT row_id, fold, round(y, 9) AS y, round(a, 9) AS a, round(b, 9) AS b, round(c, 9) AS c FROM oof", OOF
    ),
)
def oof_table(spark, sf_dir):
    table = V.out_of_fold(_predictions(spark, sf_dir), actuals(spark, sf_dir), MODELS)
    return table.select("row_id", "fold", *[F.round(c, 9).alias(c) for c in ("y", *MODELS)])


CANDIDATES = """candidates AS (
  SELECT i + 11 * j AS candidate_id, i / 10.0 AS wa, j / 10.0 AS wb, (10 - i - j) / 10.0 AS wc
  FROM range(0, 11) x(i), range(0, 11) z(j) WHERE i + j <= 10),
direct AS (
  SELECT candidate_id, fold, sqrt(avg((wa * a + wb * b + wc * c - y) ** 2)) AS rmse
  FROM oof, candidates GROUP BY ALL)"""


def _scores(spark, sf_dir):
    table = V.out_of_fold(_predictions(spark, sf_dir), actuals(spark, sf_dir), MODELS)
    return V.score_blends(V.residual_products(table, MODELS), V.weight_grid(spark, MODELS, STEPS))


@CATALOG.query(
    "blend_weight_search",
    _with_predictions("SELECT candidate_id, fold, round(rmse, 8) AS rmse FROM direct", OOF, CANDIDATES),
)
def blend_weight_search(spark, sf_dir):
    return _scores(spark, sf_dir).withColumn("rmse", F.round("rmse", 8))


@CATALOG.query(
    "best_blend",
    _with_predictions(
        """SELECT arg_min(candidate_id, (round(m, 10), candidate_id)) AS candidate_id, round(min(m), 8) AS mean_rmse
           FROM (SELECT candidate_id, avg(rmse) AS m FROM direct GROUP BY candidate_id)""",
        OOF,
        CANDIDATES,
    ),
)
def best_blend(spark, sf_dir):
    return V.best_candidate(_scores(spark, sf_dir)).withColumn("mean_rmse", F.round("mean_rmse", 8))
