"""Token arrays: n-grams, term counts, norms and padding, all inside one row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from pricemill.functions.text import let

# A bag is array<struct<feature: string, value: double>>, one entry per distinct feature.
BAG_TYPE = "array<struct<feature:string,value:double>>"


def remove_words(tokens: Column, words: Sequence[str]) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*words))


def _ngrams_of(tokens: Column, n: int) -> Column:
    if n == 1:
        return tokens
    # single elements are read at once; slice() would copy the whole array for every n-gram
    starts = F.sequence(F.lit(0), F.size(tokens) - n)
    grams = F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(tokens, i + k) for k in range(n)]))
    return F.when(F.size(tokens) >= n, grams).otherwise(F.array().cast("array<string>"))


def word_ngrams(tokens: Column, low: int, high: int) -> Column:
    """All n-grams of orders ``low``..``high``, words joined by a space, repeats kept."""
    if low == high:
        return let(tokens, lambda t: _ngrams_of(t, low))
    return let(tokens, lambda t: F.concat(*[_ngrams_of(t, n) for n in range(low, high + 1)]))


def run_lengths(values: Column) -> Column:
    """``array<struct<key, n>>``: every distinct element and how often it occurs. Sorting puts
    equal elements side by side, so the cost is n log n within the row and nothing is shuffled."""

    def runs(ordered: Column) -> Column:
        is_start = lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1))
        starts = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), is_start)
        return let(
            starts,
            lambda s: F.transform(
                s,
                lambda at, j: F.struct(
                    F.get(ordered, at).alias("key"),
                    (F.coalesce(F.get(s, j + 1), F.size(ordered)) - at).alias("n"),
                ),
            ),
        )

    return let(F.sort_array(values), lambda v: F.when(F.size(v) > 0, runs(v)))


def bag(values: Column, weight: float = 1.0, binary: bool = False) -> Column:
    """Term bag of an array of strings: value is the count (or one if ``binary``) times ``weight``.
    Null for an array without elements."""
    return F.transform(
        run_lengths(values),
        lambda r: F.struct(
            r["key"].alias("feature"),
            (F.lit(float(weight)) if binary else r["n"] * F.lit(float(weight))).alias("value"),
        ),
    )


def empty_if_null(bag_column: Column) -> Column:
    return F.coalesce(bag_column, F.array().cast(BAG_TYPE))


def concat_bags(*bags: Column) -> Column:
    return F.concat(*[empty_if_null(b) for b in bags])


def l2_normalized(bag_column: Column) -> Column:
    """Divide the values of a bag by their Euclidean norm."""

    def scale(b: Column) -> Column:
        norm = F.sqrt(F.aggregate(b, F.lit(0.0), lambda acc, e: acc + e["value"] * e["value"]))
        return let(
            norm,
            lambda z: F.transform(
                b, lambda e: F.struct(e["feature"].alias("feature"), (e["value"] / z).alias("value"))
            ),
        )

    return let(bag_column, scale)


def weighted_ngram_bag(
    tokens: Column, weights: Sequence[float], binary: bool = False, normalize: bool = False
) -> Column:
    """Bag of n-grams where order ``k`` counts ``weights[k-1]`` times. Words hold no spaces, so
    n-grams of different orders are different features and the orders can be counted apart."""
    result = let(
        tokens,
        lambda t: concat_bags(*[bag(_ngrams_of(t, k + 1), w, binary) for k, w in enumerate(weights)]),
    )
    return l2_normalized(result) if normalize else result


def hash_slots(values: Column, slots: int) -> Column:
    """Array of slot numbers (as text) of an array of strings."""
    return F.transform(values, lambda v: hash_slot(v, slots).cast("string"))


def hash_slot(value: Column, slots: int) -> Column:
    """Slot number of a string."""
    return F.pmod(F.xxhash64(value), F.lit(slots))


def prefixed(bag_column: Column, prefix: str) -> Column:
    """Put ``prefix:`` before every feature name."""
    return F.transform(
        bag_column,
        lambda e: F.struct(F.concat(F.lit(prefix + ":"), e["feature"]).alias("feature"), e["value"].alias("value")),
    )


def single(feature: Column, value: Column | float = 1.0) -> Column:
    """A bag with one entry; null for a null feature."""
    value = value if isinstance(value, Column) else F.lit(float(value))
    entry = F.array(F.struct(feature.alias("feature"), value.cast("double").alias("value")))
    return F.when(feature.isNotNull(), entry)


def pad_left(sequence: Column, length: int) -> Column:
    """Keep the last ``length`` numbers; fill with zeros on the left."""

    def pad(s: Column) -> Column:
        zeros = F.array_repeat(F.lit(0), F.greatest(F.lit(length) - F.size(s), F.lit(0)))
        kept = F.when(F.size(s) > length, F.slice(s, -length, length)).otherwise(s)
        return F.concat(zeros, kept)

    return let(F.coalesce(sequence, F.array().cast("array<int>")), pad)
