"""Wall seconds of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from pricemill.catalog import CATALOG

HEADLINE = [
    "hand_features", "zscore_features", "clean_listings", "clean_text_symbols", "token_overlap", "normalize_units",
    "brand_frequency_join", "mask_unseen", "label_encode", "rank_gauss", "rank_gauss_tied", "kfold_contiguous",
    "word_index", "text_to_sequence", "pad_sequence", "corrupt_tokens",
    "alias_normalize", "impute_brand_alias", "impute_brand_cascade", "fuzzy_brand_match", "term_dictionary",
    "count_vectorize", "hashed_ngrams", "description_ngrams", "weighted_description_ngrams", "document_frequency",
    "df_filter", "features_in_both_splits", "tfidf", "feature_union",
    "rmse_by_fold", "weighted_blend", "blend_weight_search", "oof_table", "worst_predictions",
    "ridge_dense",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("pricemill-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start-up is not a query
    seconds = {}
    for name in names:
        started = time.time()
        CATALOG.queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
