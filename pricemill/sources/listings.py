"""The ``listings``, ``predictions`` and ``actuals`` views over the given tables (FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

LISTING_SCHEMA = T.StructType(
    [
        T.StructField("row_id", T.LongType(), False),
        T.StructField("split", T.StringType(), False),
        T.StructField("name", T.StringType()),
        T.StructField("item_condition_id", T.IntegerType()),
        T.StructField("category_name", T.StringType()),
        T.StructField("brand_name", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("shipping", T.IntegerType()),
        T.StructField("item_description", T.StringType()),
    ]
)


def _every(n: int):
    return F.col("p_partkey") % n == 0


def listings(spark: SparkSession, sf_dir: str, with_description: bool = True) -> DataFrame:
    """One listing per part. The description joins in ``documents``; queries that do not read it
    pass ``with_description=False`` and scan ``part`` alone."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    is_test = F.col("p_partkey") % 4 == 3
    path = F.concat(
        "p_type", F.lit("/S"), (F.col("p_size") % 5).cast("string"),
        F.lit("/T"), F.col("p_size").cast("string"),
    )
    columns = [
        F.col("p_partkey").alias("row_id"),
        F.when(is_test, "test").otherwise("train").alias("split"),
        F.when(_every(3), F.concat_ws(" ", "p_name", "p_brand")).otherwise(F.col("p_name")).alias("name"),
        F.when(~_every(17), F.col("p_size") % 5 + 1).alias("item_condition_id"),
        F.when(is_test & _every(53), F.lit("New/Only/Test"))
        .when(_every(11), F.lit(None))
        .when(_every(7), F.col("p_type"))
        .otherwise(path)
        .alias("category_name"),
        F.when(is_test & _every(59), F.lit("Unseen Brand"))
        .when(_every(5), F.lit(None))
        .otherwise(F.col("p_brand"))
        .alias("brand_name"),
        F.when(is_test, F.lit(None))
        .when(_every(97), F.lit(0.0))
        .otherwise(F.col("p_retailprice") * (1 + F.col("p_size") % 7))
        .cast("double")
        .alias("price"),
        F.when(~_every(19), (F.col("p_partkey") % 2).cast("int")).alias("shipping"),
    ]
    if not with_description:
        return parts.select(*columns)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n_documents = documents.agg(F.count(F.lit(1))).scalar()
    description = (
        F.when(_every(13), F.lit("No description yet"))
        .when(_every(23), F.lit(None))
        .otherwise(F.col("text"))
        .alias("item_description")
    )
    # Rows are narrow before the join and carry whole texts after it, so the number of partitions
    # is fixed here: adaptive execution would merge them by their size before. A sort-merge join
    # needs this very exchange, so it costs nothing extra.
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (
        parts.withColumn("doc_id", F.col("p_partkey") % n_documents)
        .repartition(partitions, "doc_id")
        .join(documents.select("doc_id", "text"), "doc_id", "left")
        .select(*columns, description)
    )


# model name -> multiplier of the deterministic error term
PREDICTION_MODELS = {"a": 7, "b": 13, "c": 29}


def predictions(spark: SparkSession, sf_dir: str, snapshots: int = 1) -> DataFrame:
    """Deterministic predictions ``(row_id, model, snapshot, pred)`` for priced train rows."""
    priced = listings(spark, sf_dir, with_description=False).where(
        (F.col("split") == "train") & (F.col("price") > 0)
    )
    entries = F.array(
        *[
            F.struct(F.lit(m).alias("model"), F.lit(k).alias("k"), F.lit(s).alias("snapshot"))
            for m, k in PREDICTION_MODELS.items()
            for s in range(snapshots)
        ]
    )
    error = ((F.col("row_id") * F.col("e.k")) % 101 - 50) / 500.0 + F.col("e.snapshot") / 1000.0
    return priced.select("row_id", "price", F.explode(entries).alias("e")).select(
        "row_id", "e.model", "e.snapshot", (F.log1p("price") + error).alias("pred")
    )


def actuals(spark: SparkSession, sf_dir: str, folds: int = 5) -> DataFrame:
    """``(row_id, fold, y)`` for priced train rows, ``y = log1p(price)``."""
    return (
        listings(spark, sf_dir, with_description=False)
        .where((F.col("split") == "train") & (F.col("price") > 0))
        .select("row_id", (F.col("row_id") % folds).cast("int").alias("fold"), F.log1p("price").alias("y"))
    )
