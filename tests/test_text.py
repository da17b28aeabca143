"""Text rules on hand-written edge rows."""

import random

import pytest
from pyspark.sql import functions as F

from pricemill.constants import BRAND_KEYWORDS, NAME_ALIASES
from pricemill.functions import sequences as S
from pricemill.functions import text as T


def evaluate(spark, expression, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.x for r in rows.select("i", expression(F.col("t")).alias("x")).orderBy("i").collect()]


SYMBOLS = "*)(?!#$#@(@#??@#$??#??@#$?#?!@#$?!/" * 1000


@pytest.mark.parametrize(
    "function, text, wanted",
    [
        (T.clean_keep, "  Abc12 d", "abc 12 d"),
        (T.clean_keep, "10 . 5", "10.5"),
        (T.clean_keep, "1 . 2 . 3", "1.2 . 3"),
        (T.clean_keep, "vs. 3 . 4", "vs . 3.4"),
        (T.clean_keep, "A b", "a b"),
        (T.clean_keep, "café", "caf é"),
        (T.clean_whitelist, "scas*asdc & asdc", "scas asdc & asdc"),
        (T.clean_whitelist, "Men/Shirt’s", "men / shirt s"),
        (T.clean_whitelist, "Men - shirt", "men shirt"),
        (T.clean_small, "a$b 5%!", "a$b 5 %"),
        (T.clean_path, "Men&Boys/12.5", "men & boys / 12 5"),
        (T.clean_symbols, "a-b", "a - b"),
        (T.normalize_units, "14 karat ring", "14k ring"),
        (T.normalize_units, "10-kt gold", "10k gold"),
        (T.normalize_units, "18carats!", "18k!"),
        (T.normalize_units, "8 oz cup", "8oz cup"),
        (T.normalize_units, "14 karaty", "14 karaty"),
        (T.blank_boilerplate, "NO description yet", ""),
        (T.word_length, "", 1),
        (T.word_length, "a b  c", 4),
    ],
)
def test_rule(spark, function, text, wanted):
    assert evaluate(spark, function, text) == [wanted]


def test_long_symbols_and_nulls(spark):
    cleaned = evaluate(spark, T.clean_whitelist, SYMBOLS, None)
    assert cleaned[0].startswith("? ! # $ # @ @ #") and len(cleaned[0]) > 50_000 and cleaned[1] is None


def test_category_levels(spark):
    paths = ["a", "a/b", "a/b/c", "men / tops / shirt"]
    two = lambda c: F.array(*T.category_levels_2(c))
    assert evaluate(spark, two, *paths) == [["a", "missvalue"], ["a", "b"], ["a", "b"], ["men", "tops"]]
    three = lambda c: F.array(*T.category_levels_3(c).values())
    assert evaluate(spark, three, *paths)[:3] == [["other"] * 3 + ["other/other"]] * 2 + [["a", "b", "c", "a/b"]]


def test_aliases_single_pass(spark):
    rename = lambda c: T.replace_aliases(c, NAME_ALIASES)
    texts = ["vs pink air forces x", "leaf 21", "lulu lemon lulu", "nothing", ""]
    wanted = ["vs_pink air_forces x", "leaforever_21", "lululemon lululemon", "nothing", ""]
    assert evaluate(spark, rename, *texts) == wanted
    chain = lambda c: T.replace_aliases(c, [("a", "b"), ("b", "c")])
    assert evaluate(spark, chain, "ab") == ["bc"]


def test_first_keyword(spark):
    keywords = dict(BRAND_KEYWORDS)
    assert evaluate(spark, lambda c: T.first_keyword_value(c, keywords), "new wii and ipad", "none") == ["nintendo", None]


def test_overlap(spark):
    rows = spark.createDataFrame([("a b b", "b c"), ("x", "y"), ("", "")], "l string, r string")
    values = [r.x for r in rows.select(T.token_overlap(F.col("l"), F.col("r")).alias("x")).collect()]
    assert values == [1 / 3, 0.0, 0.5]
    assert all(0 <= v < 1 for v in values)


def test_tokens_ngrams_and_bags(spark):
    grams = lambda c: S.word_ngrams(S.remove_words(T.find_tokens(c), ["the"]), 1, 2)
    assert evaluate(spark, grams, "big the café a", "x", "") == [["big", "café", "big café"], [], []]
    counts = lambda c: S.bag(F.split(c, " "))
    got = evaluate(spark, counts, "b a b")[0]
    assert [(e.feature, e.value) for e in got] == [("a", 1.0), ("b", 2.0)]
    norm = lambda c: F.aggregate(
        S.weighted_ngram_bag(F.split(c, " "), [2.0, 0.5], normalize=True),
        F.lit(0.0), lambda s, e: s + e["value"] * e["value"],
    )
    assert evaluate(spark, norm, "b a b c")[0] == pytest.approx(1.0)
    binary = lambda c: S.weighted_ngram_bag(F.split(c, " "), [2.0, 0.5], binary=True)
    assert {e.feature: e.value for e in evaluate(spark, binary, "a a")[0]} == {"a": 2.0, "a a": 0.5}


def test_padding(spark):
    numbers = lambda c: S.pad_left(F.transform(F.split(c, " "), lambda t: t.cast("int")), 3)
    assert evaluate(spark, numbers, "7", "6 7 8 9") == [[0, 0, 7], [7, 8, 9]]
    assert spark.range(1).select(S.pad_left(F.lit(None).cast("array<int>"), 2)).first()[0] == [0, 0]


def test_hash_slots_in_range(spark):
    slots = evaluate(spark, lambda c: S.hash_slots(F.split(c, " "), 8), "a b c d e f g h i j")[0]
    assert all(0 <= int(s) < 8 for s in slots)


def test_distances_of_pairs_aligned_together(spark):
    """Long words beside short ones, each pair in its place, as the expression gives them; nulls stay null."""
    from pricemill.functions.alignment import aligned_distance, osa_distances
    from pricemill.functions.distance import osa_distance

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("ab😀é") for _ in range(rng.choice([0, 1, 3, 6, 9, 65])))
    pairs = [(word(), word()) for _ in range(400)] + [("ca", "abc"), (None, "a"), ("a", None), ("ab" * 150, "ba" * 150)]
    rows = spark.createDataFrame(pairs, "a string, b string")
    found = rows.select(aligned_distance(F.col("a"), F.col("b")).alias("x"), osa_distance(F.col("a"), F.col("b")).alias("y")).collect()
    assert all(r.x == r.y for r in found) and sum(r.x is None for r in found) == 2
    assert osa_distances(["ab" * 1500, "", "abcd"], ["ba" * 1500, "abc", "badc"]).tolist() == [2, 3, 2]
