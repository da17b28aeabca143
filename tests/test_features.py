"""Long feature tables: frequencies, filters and weights."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pricemill.operators import features as X


@pytest.mark.parametrize("room", [0, 5, 200_000])
def test_features_are_answered_by_broadcast_as_far_as_there_is_room(spark, monkeypatch, room):
    """The same rows whatever is broadcast; nothing is shuffled if all kept features are."""
    monkeypatch.setattr(X, "BROADCAST_ROWS", room)
    monkeypatch.setattr(X, "HOT_SHARE", 10)
    entries = [(i, f"w{j}", float(j)) for j in range(40) for i in range(1 + j % 13)]
    features = spark.createDataFrame(entries, "row_id long, feature string, value double")
    sizes = Counter(f for _, f, _ in entries)
    found = X.df_filter(features, 3)
    assert sorted(map(tuple, found.collect())) == sorted(e for e in entries if sizes[e[1]] >= 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert ("Union" in plan) == (room < 40)
    weighted = {(r.row_id, r.feature): r.value for r in X.tfidf(features, F.lit(13)).collect()}
    value = {(i, f): v * (math.log(14 / (1 + sizes[f])) + 1) for i, f, v in entries}
    norm = {i: math.sqrt(sum(v * v for (k, _), v in value.items() if k == i)) for i, _, _ in entries}
    assert weighted == pytest.approx({(i, f): v / norm[i] for (i, f), v in value.items()})


def test_staged_features_hold_no_keys_and_are_packed_closest(spark):
    features = spark.createDataFrame([(1, "a b", 1.0), (2, "a", 2.0)], "row_id long, feature string, value double")
    keyed = X.keyed_features(features)
    files = keyed.inputFiles()
    assert files and all(f.endswith(".zstd.parquet") for f in files) and spark.read.parquet(*files).columns == features.columns
    assert {(r.feature, r.key) for r in keyed.collect()} == {tuple(r) for r in features.select("feature", F.xxhash64("feature")).collect()}
