"""Benchmark decontamination by spaced seeds.

A document and an item overlap if some aligned stretch of at least ``LEAST_TOKENS`` tokens has at least
``LEAST_PERCENT`` equal ones. A stretch of twice that length can be halved and one half is as good, so only
stretches of fewer than ``2 * LEAST_TOKENS`` tokens have to be looked at. Each of them holds a seed: a hash of the
tokens that one of the masks ``SEEDS`` keeps, wherever the replaced tokens stand. Documents and items give seeds at
every position. Those of documents take the hashes of the tokens around them along, so the texts are read
once and not shuffled; they are joined on their hashes, and around each hit all stretches of its diagonal are tried.
A table of bits of bounded size keeps seeds that no test seed equals out of the join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from pricemill.session import stage

# Masks of the seeds: 1 keeps the token at this place, 0 ignores it. Every aligned stretch of at least LEAST_TOKENS
# tokens with LEAST_PERCENT equal agrees with one of them somewhere.
SEEDS = ("111011", "11111")
# The least overlap, and the share that must agree.
LEAST_TOKENS = 13
LEAST_PERCENT = 80
# Tokens before and after the start of a seed: all stretches of fewer than 2 * LEAST_TOKENS tokens that hold it.
BEFORE, AFTER = 2 * LEAST_TOKENS - 6, 2 * LEAST_TOKENS - 2
# The table of bits that documents' seeds must pass has 32 bits per test seed, between these powers of two:
# at most 512 KB. It only saves work; with a benchmark beyond it more seeds are joined.
LEAST_BITS, MOST_BITS = 16, 22


def tokens(text: str) -> Column:
    """Lower-case runs of letters and digits; a null text has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^\\p{L}\\p{N}]+"), "")


def _seeds(hashes: Column, may_meet=None) -> Column:
    """[(hash, token hashes around)] of the seeds at every position that ``may_meet`` a test seed."""

    def of(mask: int) -> Column:
        kept = [i for i, bit in enumerate(SEEDS[mask]) if bit == "1"]
        spots = F.when(F.size(hashes) >= len(SEEDS[mask]), F.sequence(F.lit(0), F.size(hashes) - len(SEEDS[mask]))).otherwise(
            F.array().cast("array<int>")
        )
        made = F.transform(spots, lambda at: F.xxhash64(F.lit(mask), *[F.get(hashes, at + i) for i in kept]))
        one = lambda hash_, at: F.struct(hash_.alias("hash"), at.alias("at"))
        if may_meet is not None:
            made = F.filter(F.transform(made, lambda h, at: F.when(may_meet(h), one(h, at))), lambda s: s.isNotNull())
        else:
            made = F.transform(made, one)
        return F.transform(made, lambda s: F.struct(
            s["hash"].alias("hash"), _around(hashes, s["at"]).alias("around")
        ))

    return F.concat(*[of(mask) for mask in range(len(SEEDS))])


def _around(hashes: Column, at: Column) -> Column:
    """The token hashes from ``BEFORE`` before the start of a seed to ``AFTER`` after it; null beyond the text."""
    return F.transform(F.sequence(F.lit(-BEFORE), F.lit(AFTER)), lambda o: F.get(hashes, at + o))


def _bits(flags: Column) -> Column:
    """Flags as a number, the first one in the lowest bit."""
    shifted = F.transform(flags, lambda flag, i: F.when(flag, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(shifted, F.lit(0).cast("bigint"), lambda all_, bit: all_.bitwiseOR(bit))


def _most_wrong(n: int) -> int:
    return n * (100 - LEAST_PERCENT) // 100


def _part(bits: Column, at: Column, n: int) -> Column:
    return F.call_function("shiftright", bits, at).bitwiseAND(F.lit((1 << n) - 1).cast("bigint"))


def _starts(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(BEFORE + AFTER + 1 - n))


def _overlaps(equal: Column, both: Column) -> Column:
    """Whether a stretch of the aligned tokens, all of them inside both texts, has enough equal ones."""
    # a stretch of another length holds one of these that is as good
    lengths = [n for n in range(LEAST_TOKENS, 2 * LEAST_TOKENS) if n == LEAST_TOKENS or _most_wrong(n) > _most_wrong(n - 1)]

    def any_good(at: Column) -> Column:
        good = [
            (F.bit_count(_part(equal, at, n)) >= n - _most_wrong(n)) & (_part(both, at, n) == (1 << n) - 1) for n in lengths
        ]
        return reduce(lambda one, other: one | other, good)

    return F.exists(_starts(LEAST_TOKENS), any_good)


def _most_equal(equal: Column, both: Column) -> Column:
    """The most equal tokens of a good stretch of fewer than twice ``LEAST_TOKENS`` tokens; null if there is none."""

    def best(n: int) -> Column:
        found = F.transform(_starts(n), lambda at: F.when(_part(both, at, n) == (1 << n) - 1, F.bit_count(_part(equal, at, n))))
        most = F.array_max(found)
        return F.when(most >= n - _most_wrong(n), most)

    return F.greatest(*[best(n) for n in range(LEAST_TOKENS, 2 * LEAST_TOKENS)])


def _places(hash_: Column, bits: int) -> list[Column]:
    """Two bits of the table for a hash."""
    return [F.shiftrightunsigned(hash_, 64 - bits), hash_.bitwiseAND((1 << bits) - 1)]


def bit_test(seeds: DataFrame, n: int):
    """A condition that holds for every hash in column ``hash`` of the ``n`` seeds, and for few others."""
    bits = min(MOST_BITS, max(LEAST_BITS, (32 * n).bit_length()))
    place = seeds.select(F.explode(F.array(*_places(F.col("hash"), bits))).alias("place"))
    words = place.select(F.shiftright("place", 5).alias("word"), F.expr("shiftleft(1L, cast(place & 31 as int))").alias("bit"))
    table = [0] * (1 << bits - 5)
    for row in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():  # no more rows than the table has words
        table[row["word"]] = row["bits"]
    constant = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")
    is_set = lambda at: F.getbit(F.get(constant, F.shiftright(at, 5).cast("int")), at.bitwiseAND(31).cast("int")) == 1

    def may_meet(hash_: Column) -> Column:
        one, two = _places(hash_, bits)
        return is_set(one) & is_set(two)

    return may_meet


def contamination(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row per document and benchmark item that overlap: the key columns and ``overlap``.

    A pair overlaps if an aligned stretch of at least ``LEAST_TOKENS`` tokens, all inside both texts, has at
    least ``LEAST_PERCENT`` equal ones; all such pairs are found. ``overlap`` is the most equal tokens of such a stretch
    of fewer than twice that length. Items of fewer tokens than ``LEAST_TOKENS`` can't be told from chance and match
    nothing. Rows without a key are not reported.
    """
    hashed = lambda words: F.transform(words, lambda w: F.xxhash64(w))
    items = benchmark.select(F.col(item).alias("_llm_item"), hashed(tokens(item_text)).alias("_llm_words"))
    items = items.where(F.size("_llm_words") >= LEAST_TOKENS)
    item_seeds = stage(
        # the outer form keeps the optimizer from putting a filter on the seeds below the tokens' projection, where
        # it would split the text anew for every token
        items.select("_llm_item", F.explode_outer(_seeds(F.col("_llm_words"))).alias("s"))
        .select("_llm_item", "s.hash", F.col("s.around").alias("_llm_test")).distinct(),
        "benchmark-seeds",
    )
    may_meet = bit_test(item_seeds.select("hash").distinct(), item_seeds.count())
    read = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("_llm_doc"), hashed(tokens(text)).alias("_llm_words"))
    seeded = read.select("_llm_doc", F.explode_outer(_seeds(F.col("_llm_words"), may_meet)).alias("s"))
    doc_seeds = seeded.where("s is not null").select("_llm_doc", "s.hash", F.col("s.around").alias("_llm_train"))
    met = doc_seeds.join(item_seeds, "hash")
    pairs = F.zip_with("_llm_train", "_llm_test", lambda a, b: a == b)  # null where a text has ended
    compared = met.select(
        "_llm_doc", "_llm_item",
        _bits(F.transform(pairs, lambda x: F.coalesce(x, F.lit(False)))).alias("same"),
        _bits(F.transform(pairs, lambda x: x.isNotNull())).alias("both"),
    )
    # the confirmed places are few; those of a pair that say the same are one before they are measured
    sure = compared.where(_overlaps(F.col("same"), F.col("both"))).distinct()
    best = sure.withColumn("most", _most_equal(F.col("same"), F.col("both")))
    return best.groupBy(F.col("_llm_doc").alias(key), F.col("_llm_item").alias(item)).agg(F.max("most").cast("bigint").alias("overlap"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that overlap a benchmark item. Rows without a key stay."""
    found = contamination(docs.select(key, text), benchmark, key, text)
    gone = found.select(F.col(key).alias("_llm_gone")).distinct()
    return docs.join(gone, F.col(key) == F.col("_llm_gone"), "left_anti")
