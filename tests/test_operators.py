"""Ranks, joins, folds, fuzzy lookup, filling and evaluation against brute force."""

import math
import random
import statistics
from itertools import product

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import Window, functions as F

from pricemill.functions.distance import osa_distance
from pricemill.functions.numeric import erfinv
from pricemill.operators import brands, encode, evaluate, features, fuzzy, joins, ranking, scale


def osa(a, b):
    """Distance by the recurrence, cell by cell."""
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if i == 0 or j == 0}
    for i, j in product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


PAIRS = [("ba", "abc", 2), ("fee", "deed", 2), ("abcd", "bacde", 2), ("ca", "abc", 3), ("", "ab", 2), ("a", "a", 0)]


def test_distance_examples(spark):
    rows = spark.createDataFrame(PAIRS, "a string, b string, d int")
    out = rows.select("d", osa_distance(F.col("a"), F.col("b")).alias("x"), osa_distance(F.col("a"), F.col("b"), 2).alias("y"))
    for row in out.collect():
        assert row.x == row.d and row.y == (row.d if row.d <= 2 else None)


def test_distance_of_random_pairs(spark):
    """Few letters, so that swaps are frequent; lengths about the borders of blocks; characters of all widths."""
    rng = random.Random(8)
    word = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    pairs = [(word(rng.randint(0, 7), "abc"), word(rng.randint(0, 7), "abc")) for _ in range(1500)]
    pairs += [(word(rng.randint(0, 6), "aé𝄞"), word(rng.randint(0, 6), "aé𝄞")) for _ in range(100)]
    for n in (59, 60, 61, 62, 119, 120, 121, 180):
        for letters in ("ab", "abcdefgh"):
            a = word(n, letters)
            b = list(a)
            for _ in range(rng.randint(1, 12)):
                i = rng.randrange(1, len(b))
                b[i - 1 : i + 1] = rng.choice([[b[i], b[i - 1]], [b[i]], [b[i - 1], "x", b[i]], ["y", b[i]]])
            pairs += [(a, "".join(b)), (a, word(n + rng.randint(-3, 3), letters))]
    # swaps across the border of two blocks, one after another
    pairs += [("a" * 59 + "bc" + "d" * 70, "a" * 59 + "cb" + "d" * 70), ("xy" * 70, "yx" * 70)]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)] + [(-1, None, "a"), (-2, "a", None)], "i int, a string, b string")
    distances = rows.select("i", osa_distance(F.col("a"), F.col("b")).alias("d"), osa_distance(F.col("a"), F.col("b"), 3).alias("near"))
    assert "Python" not in distances._jdf.queryExecution().toString()
    for r in distances.collect():
        wanted = osa(*pairs[r.i]) if r.i >= 0 else None
        assert r.d == wanted and r.near == (wanted if wanted is not None and wanted <= 3 else None), pairs[r.i]


@pytest.mark.parametrize("limit", [1, 2, 3])
def test_fuzzy_against_all_pairs(spark, limit):
    words = sorted({"".join(p) for n in (1, 2, 3) for p in product("ab", repeat=n)} | {
        "internationally", "internationaly", "nternationally", "intrenationally", "international", "xnternationally"})
    queries = spark.createDataFrame([(w,) for w in words], "query string")
    dictionary = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "term string, n long")
    found = {(r.query, r.term): r.distance for r in fuzzy.fuzzy_candidates(queries, dictionary, limit).collect()}
    wanted = {(a, b): osa(a, b) for a, b in product(words, words) if osa(a, b) <= limit and set(a) & set(b)}
    assert found == wanted
    best = fuzzy.fuzzy_match(queries, dictionary, limit, fuzzy.BEST).collect()
    assert {(r.query, r.term) for r in best} == {(w, w) for w in words}
    every = fuzzy.fuzzy_match(queries, dictionary, limit, fuzzy.ALL)
    assert every.count() == len(wanted)


@pytest.mark.parametrize("limit", [1, 2, 3])
def test_fuzzy_against_all_random_pairs(spark, limit):
    """Edits and swaps at every place, on segment borders too; other characters than letters; nulls and empty words."""
    rng = random.Random(limit)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(1, 11))) for _ in range(130)}
    for word in sorted(words)[:60]:
        for at in range(1, len(word), 2):
            words.add(word[: at - 1] + word[at] + word[at - 1] + word[at + 1 :])
    words = sorted(words)
    queries = spark.createDataFrame([(w,) for w in words] + [(None,), ("",), (words[0],)], "query string")
    dictionary = spark.createDataFrame([(w, 1) for w in words] + [(None, 1), ("", 1)], "term string, n long")
    found = fuzzy.fuzzy_candidates(queries, dictionary, limit).collect()
    wanted = {(a, b): osa(a, b) for a in words for b in words if abs(len(a) - len(b)) <= limit and set(a) & set(b)}
    wanted = {p: d for p, d in wanted.items() if d <= limit}
    assert len(found) == len(wanted) and {(r.query, r.term): r.distance for r in found} == wanted


def test_common_beginning_is_dealt_out(spark):
    """A segment that all words share: no task of the join gets more than a small part of the pairs."""
    words = ["prefix" + "".join(p) for p in product("abcdefghij", repeat=3)]
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        left = spark.createDataFrame([(w, 1) for w in words], "query string, segment long")
        right = spark.createDataFrame([(w, 1) for w in words], "term string, segment long").hint("merge")
        pairs = joins.grid_match(left, right, "segment", F.col("query"), F.col("term"))
        sizes = [r["count"] for r in pairs.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert sum(sizes) == len(words) ** 2 and max(sizes) < len(words) ** 2 / 8


def test_match_of_sides_without_a_common_key(spark):
    left = spark.createDataFrame([("a", 1), ("b", None)], "query string, segment long")
    right = spark.createDataFrame([("x", 2), ("y", None)], "term string, segment long")
    assert joins.grid_match(left, right, "segment", F.col("query"), F.col("term")).count() == 0


def test_fields_by_kind(spark):
    rows = spark.sql("""select * from values (1L, 'b', true, 1.5d, 2.50, 7), (2L, null, null, null, null, null), (3L, 'a', false, 0d, 1.00, 1),
                        (4L, 'b', true, 2d, 0.25, 1) as t(row_id, brand, flag, price, cost, size)""")
    got = encode.select_fields(rows, ["brand", "size"]).orderBy("row_id").collect()
    assert [tuple(r) for r in got] == [(1, 1, 1, 1.5, 2.5, 1), (2, None, None, None, None, None), (3, 0, 0, 0.0, 1.0, 0), (4, 1, 1, 2.0, 0.25, 0)]
    with pytest.raises(ValueError):
        encode.select_fields(rows, ["nothing"])
    with pytest.raises(TypeError):
        encode.select_fields(rows.withColumn("list", F.array(F.lit(1))))


def test_sequences_against_a_dictionary(spark):
    """Nulls, empty texts, texts without a known word, many batches; no exchange after the rows are read."""
    texts = [None, "", "   ", "a B  a", "zz a", "zz", "b b", "é a"] * 40
    rows = spark.createDataFrame(list(enumerate(texts)), "row_id long, t string").repartition(3)
    index = spark.createDataFrame([("a", 1, 9), ("b", 2, 5), ("é", 3, 1)], "word string, idx int, n long")
    numbers = {"a": 1, "b": 2, "é": 3}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = encode.text_to_sequence(rows, "t", index)
        assert {r.row_id: r.seq_t for r in got.collect()} == {
            i: [numbers[w] for w in (t or "").lower().split(" ") if w in numbers] for i, t in enumerate(texts)
        }
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    read = encode.text_to_sequence(spark.range(5).selectExpr("id as row_id", "'a b' as t"), "t", index)
    assert "Exchange" not in read._jdf.queryExecution().executedPlan().toString()
    assert encode.text_to_sequence(rows, "t", index.limit(0)).where("size(seq_t) > 0").count() == 0


@pytest.fixture
def many_partitions(spark):
    """Small tables keep all the shuffle partitions that are asked for."""
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "37"}
    before = {k: spark.conf.get(k) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield 37
    for key, value in before.items():
        spark.conf.set(key, value)


@pytest.mark.parametrize("order", ["o_totalprice", "o_orderpriority", "constant"])
def test_global_rank_over_many_partitions(spark, sf_dir, order, many_partitions):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("constant", F.lit(1)).select("o_orderkey", order)
    ranked, n = ranking.global_rank(rows, [F.col(order)], "o_orderkey")
    right = F.row_number().over(Window.orderBy(order, "o_orderkey")) - 1
    assert ranked.count() == n == rows.count()
    assert ranked.withColumn("right", right).where("rank0 <> right").count() == 0


def test_rank_with_nulls_and_few_rows(spark):
    rows = spark.createDataFrame([(1, None), (2, 5.0), (3, float("nan")), (4, -1.0)], "row_id long, v double")
    ranked, _ = ranking.global_rank(rows, [F.col("v")])
    assert [r.row_id for r in ranked.orderBy("rank0").collect()] == [1, 4, 2, 3]
    none, n = ranking.global_rank(rows.limit(0), [F.col("v")])
    assert n == 0 and none.count() == 0


def test_rank_deals_equal_values_over_partitions(spark, sf_dir, many_partitions):
    """Rows with one value lie in all partitions, none of which holds a large share; the input is read twice."""
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey").mapInArrow(counted, "o_orderkey long")
    ranked, n = ranking.global_rank(rows, [F.lit(1)], "o_orderkey")
    assert [r.rank0 for r in ranked.orderBy("o_orderkey").collect()] == list(range(n))
    sizes = [r["count"] for r in spark.read.parquet(*set(ranked.inputFiles())).groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == many_partitions and max(sizes) < 4 * n / many_partitions
    assert reads.value == 2 * n


def test_rank_gauss_is_symmetric(spark):
    rows = spark.range(501).select(F.col("id").alias("row_id"), F.sin("id").alias("v"))
    values = [r.gauss for r in ranking.rank_gauss(rows, "v").collect()]
    assert sum(values) == pytest.approx(0, abs=1e-9) and max(values) == pytest.approx(-min(values))
    one = spark.createDataFrame([(1, 2.0)], "row_id long, v double")
    assert [r.gauss for r in ranking.rank_gauss(one, "v").collect()] == [0.0]


def test_erfinv(spark):
    xs = [-0.999999999, -0.9, -0.3, 0.0, 0.2, 0.86, 0.9999]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(erfinv("x").alias("y")).collect()
    for x, row in zip(xs, got):
        assert row.y == pytest.approx(statistics.NormalDist().inv_cdf((x + 1) / 2) / math.sqrt(2), abs=1e-9)


def test_contiguous_folds(spark):
    rows = spark.range(11).withColumnRenamed("id", "row_id")
    sizes = [r["count"] for r in ranking.contiguous_folds(rows, 5).groupBy("fold").count().orderBy("fold").collect()]
    assert sizes == [3, 2, 2, 2, 2]
    few = ranking.contiguous_folds(spark.range(2).withColumnRenamed("id", "row_id"), 5)
    assert [r.fold for r in few.orderBy("row_id").collect()] == [0, 1]


def test_hashed_folds_are_even(spark):
    rows = spark.range(10_000).withColumnRenamed("id", "row_id")
    sizes = [r["count"] for r in ranking.hashed_folds(rows, 5, 2018).groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) < 300


def skewed(spark):
    """A third of the rows share a key, a tenth have none, some have a key the table lacks."""
    key = (
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 10 == 1, F.lit(None))
        .when(F.col("id") % 50 == 2, "unknown").otherwise(F.concat(F.lit("k"), (F.col("id") % 97).cast("string")))
    )
    return spark.range(3000).select(F.col("id").alias("row_id"), key.alias("key"))


@pytest.mark.parametrize("broadcast", ["-1", "10485760"])
@pytest.mark.parametrize("weighted", [True, False])
def test_lookup_join_with_a_hot_key(spark, weighted, broadcast):
    rows = skewed(spark)
    table = rows.where("key <> 'unknown'").groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.length("key"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        got = joins.lookup_join(
            rows, table if weighted else table.drop("n"), "key", F.col("row_id"), "n" if weighted else None, share=10
        )
        wanted = rows.join(table.drop("n"), "key", "left").select("row_id", "key", "v")
        small = joins.lookup_join(rows, table.drop("n"), "key", F.col("row_id"), measure=True)
        assert sorted(small.collect(), key=lambda r: r.row_id) == sorted(wanted.collect(), key=lambda r: r.row_id)
        assert sorted(got.collect(), key=lambda r: r.row_id) == sorted(wanted.collect(), key=lambda r: r.row_id)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_salted_match(spark):
    rows = skewed(spark)
    table = rows.select("key").distinct().where("key is not null").withColumn("v", F.length("key"))
    got = joins.salted_match(rows, table, ["key"], F.col("row_id")).select("row_id", "v")
    assert sorted(got.collect()) == sorted(rows.join(table, "key").select("row_id", "v").collect())


def test_frequency_and_unseen(spark):
    rows = spark.createDataFrame(
        [(1, "train", "a"), (2, "train", "missvalue"), (3, "test", "a"), (4, "test", "b")], "row_id long, split string, brand string")
    frequency = {r.row_id: r.brand_frec for r in encode.frequency_join(rows, "brand").collect()}
    assert frequency == {1: 2, 2: 0, 3: 2, 4: 1}
    masked = {r.row_id: r.brand for r in encode.mask_unseen(rows, "brand").collect()}
    assert masked == {1: "a", 2: "missvalue", 3: "a", 4: "missvalue"}


def test_word_index_order_and_limit(spark):
    rows = spark.createDataFrame([(1, "b a  b"), (2, "C c a d")], "row_id long, t string")
    index = encode.word_index(rows, "t", size=4)
    assert [(r.word, r.idx, r.n) for r in index.orderBy("idx").collect()] == [("b", 1, 2), ("a", 2, 2), ("c", 3, 2)]
    texts = spark.createDataFrame([(1, "d a b zz A"), (2, ""), (3, None)], "row_id long, t string")
    sequences = encode.text_to_sequence(texts, "t", index).orderBy("row_id").collect()
    assert [r.seq_t for r in sequences] == [[2, 1, 2], [], []]


def test_zscore_of_a_constant_is_null(spark):
    rows = spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, 5.0)], "row_id long, x double, c double")
    got = scale.zscore(rows, ["x", "c"]).orderBy("row_id").collect()
    assert [r.x for r in got] == [-1.0, 1.0] and [r.c for r in got] == [None, None]


def test_cascade_order(spark):
    rows = spark.createDataFrame(
        [(1, "air max one", "", "nike"), (2, "nike air max", "", ""), (3, "air max nike", "puma x", ""),
         (4, "plain", "air max", ""), (5, "old puma", "nike", ""), (6, "none", "a puma nike", ""), (7, "none", "none", ""),
         (8, "x", "y", "air max"), (9, "x", "y", "puma")],
        "row_id long, name string, item_description string, brand_name string")
    got = {r.row_id: r.brand_name for r in brands.impute_brand_cascade(rows).collect()}
    assert got == {1: "nike", 2: "nike", 3: "air max", 4: "air max", 5: "puma", 6: "puma", 7: "", 8: "air max", 9: "puma"}


def test_cascade_against_brute_force_and_one_reading_of_the_texts(spark):
    picks = random.Random(5)
    words = ["air", "max", "nike", "puma", "one", "é", "x2", "plain"]
    text = lambda: picks.choice([None, "", " ".join(picks.choices(words, k=picks.randint(1, 6))), "air\tmax " + picks.choice(words)])
    brand = lambda: picks.choice(["", "", "", None, "nike", "puma", "air max", "x2 one"])
    rows = [(i, text(), text(), brand()) for i in range(600)]
    known = {b for *_, b in rows if b}

    def right(name, description, brand):
        if brand != "":
            return brand
        texts = [(t or "").replace("\t", " \t ").split(" ") for t in (name, description)]
        pairs = [" ".join(t[:2]) for t in texts]
        return next((t for t in pairs if " " in t and t in known), None) or next(
            (w for t in texts for w in t if w in known), "")

    reads = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def cleaned(names: pd.Series) -> pd.Series:
        reads.add(len(names))
        return names

    table = spark.createDataFrame(rows, "row_id long, name string, item_description string, brand_name string")
    got = brands.impute_brand_cascade(table.withColumn("name", cleaned("name")))
    assert got.columns == table.columns
    filled = {r.row_id: (r.name, r.item_description, r.brand_name) for r in got.collect()}
    assert filled == {i: (n, d, right(n, d, b)) for i, n, d, b in rows}
    assert reads.value == len(rows)


def test_bit_filter_passes_all_keys_and_few_others(spark):
    keys = spark.range(0, 40_000, 2).select(F.col("id").cast("string").alias("k")).unionByName(
        spark.createDataFrame([(None,)], "k string"))
    test = joins.bit_filter(keys, "k")
    passed = spark.range(40_000).where(test(F.col("id").cast("string"))).groupBy((F.col("id") % 2).alias("odd")).count()
    found = {r.odd: r["count"] for r in passed.collect()}
    assert found[0] == 20_000 and found.get(1, 0) < 800
    none = joins.bit_filter(keys.limit(0), "k")
    assert spark.range(10).where(none(F.col("id").cast("string"))).count() == 0


def test_document_frequency_filters(spark):
    table = spark.createDataFrame(
        [(1, "train", "a", 1.0), (2, "train", "a", 1.0), (3, "test", "a", 1.0), (1, "train", "b", 1.0), (3, "test", "c", 1.0)],
        "row_id long, split string, feature string, value double")
    kept = lambda t: sorted({r.feature for r in t.collect()})
    assert kept(features.df_filter(table, min_df=2)) == ["a"]
    assert kept(features.df_filter(table, min_df=1, max_df=0.5)) == ["b", "c"]
    assert kept(features.train_df_filter(table, k=1)) == ["a"]
    assert kept(features.train_df_filter(table, k=0)) == ["a", "b"]
    assert kept(features.features_in_both_splits(table)) == ["a"]


def test_blend_scores_equal_direct_scores(spark):
    models = ["a", "b", "c"]
    rows = [(i, i % 3, math.sin(i), math.sin(i) + 0.1 * (i % 7), math.cos(i), 0.3 * i % 1) for i in range(60)]
    oof = spark.createDataFrame(rows, "row_id long, fold int, y double, a double, b double, c double")
    grid = evaluate.weight_grid(spark, models, 4)
    weights = {}
    for r in grid.collect():
        weights.setdefault(r.candidate_id, {})[r.model] = r.weight
    assert len(weights) == 15 and all(sum(w.values()) == pytest.approx(1) for w in weights.values())
    scores = evaluate.score_blends(evaluate.residual_products(oof, models), grid).collect()
    assert len(scores) == 45
    for s in scores:
        errors = [(sum(weights[s.candidate_id][m] * r[3 + j] for j, m in enumerate(models)) - r[2]) ** 2 for r in rows if r[1] == s.fold]
        assert s.rmse == pytest.approx(math.sqrt(sum(errors) / len(errors)), abs=1e-9)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-5, 5), min_size=1, max_size=8))
def test_weighted_blend_stays_between_models(spark, values):
    rows = [(1, f"m{i}", v) for i, v in enumerate(values)]
    predictions = spark.createDataFrame(rows, "row_id long, model string, pred double")
    blend = evaluate.weighted_blend(predictions, {f"m{i}": i + 1.0 for i in range(len(values))}).first().pred
    assert min(values) - 1e-9 <= blend <= max(values) + 1e-9


def test_word_index_hashes_words_and_breaks_ties_by_first_appearance(spark):
    rows = spark.createDataFrame([(-3, "d c"), (2**40, "a b"), (7, "b c a d"), (8, None)], "row_id long, text string")
    index = encode.word_index(rows, "text")
    plan = index._jdf.queryExecution().sparkPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    assert [r.word for r in index.orderBy("idx").collect()] == ["d", "c", "b", "a"]
