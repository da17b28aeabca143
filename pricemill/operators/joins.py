"""Joins to a table with unique keys that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from pricemill.session import stage

# A key is hot when it holds more than 1/HOT_SHARE of the rows; so there are fewer than HOT_SHARE
# hot keys, whatever the data, and their part of the table may be broadcast.
HOT_SHARE = 1000

# A measured table is broadcast whole up to this many rows and characters of keys.
BROADCAST_ROWS = 200_000
BROADCAST_CHARACTERS = 20_000_000

# A bit filter has 16 to 32 bits per key, between these powers of two; the larger is 128 KB.
LEAST_FILTER_BITS, MOST_FILTER_BITS = 10, 20


def key_counts(rows: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Rows per non-null key."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(name))


def fits_broadcast(table: DataFrame, key: str) -> bool:
    """Measure a table (one job over it) against the broadcast bounds."""
    size = table.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.col(key).cast("string"))).alias("c")).first()
    return size["n"] <= BROADCAST_ROWS and (size["c"] or 0) <= BROADCAST_CHARACTERS


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    spread: Column,
    weight: str | None = None,
    share: int = HOT_SHARE,
    measure: bool = False,
) -> DataFrame:
    """Left join ``rows`` to ``table`` (unique on ``key``), appending the table's other columns.

    Hot keys are answered from a broadcast of fewer than ``share`` table rows; for the shuffle of
    the rest, rows with a hot or null key get a key made from ``spread`` (any column that varies
    within a key) and so are dealt out evenly. Every row is kept and every key is answered.
    ``weight`` names the table column that holds the rows per key; without it they are counted.

    With ``measure`` the table's size is taken first; if it is within the broadcast bounds the rows
    are not shuffled at all. Worth a job when rows carry whole texts and the table is cheap to make.
    """
    values = [c for c in table.columns if c not in (key, weight)]
    if measure and fits_broadcast(table, key):
        small = table.select(F.col(key).alias("_table_key"), *values)
        return rows.join(F.broadcast(small), F.col(key) == F.col("_table_key"), "left").drop("_table_key")
    if weight is None:
        counts = key_counts(rows, key, "_n")
        hot_counts = counts.where(F.col("_n") * share > counts.agg(F.sum("_n")).scalar())
        hot = hot_counts.join(table, key, "left")
    else:
        hot = table.where(F.col(weight) * share > table.agg(F.sum(weight)).scalar())
    hot = hot.select(F.col(key).alias("_hot_key"), F.struct(*values).alias("_hot"))
    cold_key = F.col(key).cast("string")
    cold = table.select(
        cold_key.alias("_cold_key"), F.xxhash64(cold_key).alias("_cold_hash"), F.struct(*values).alias("_cold")
    )
    is_hot = F.col("_hot_key").isNotNull()
    dealt = F.concat(F.lit("\x00"), F.xxhash64(spread).cast("string"))
    joined = (
        rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
        .withColumn("_key", F.when(is_hot | F.col(key).isNull(), dealt).otherwise(F.col(key).cast("string")))
        # the hash comes first: sorting by a number is cheaper than by texts with common beginnings
        .join(cold, (F.xxhash64("_key") == F.col("_cold_hash")) & (F.col("_key") == F.col("_cold_key")), "left")
    )
    answers = [F.when(is_hot, F.col("_hot")[v]).otherwise(F.col("_cold")[v]).alias(v) for v in values]
    return joined.select(*[F.col(c) for c in rows.columns], *answers)


def salted_match(
    rows: DataFrame, table: DataFrame, keys: list[str], spread: Column, salts: int = 32
) -> DataFrame:
    """Inner join to a table that is much smaller than ``rows``: the table is repeated once per
    salt, so the rows of one key are dealt over ``salts`` tasks. No counting pass is needed."""
    salted_rows = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    salted_table = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted_rows.join(salted_table, [*keys, "_salt"]).drop("_salt")


def grid_match(
    left: DataFrame, right: DataFrame, key: str, left_spread: Column, right_spread: Column, share: int = 100
) -> DataFrame:
    """Inner join on a key that may be hot on both sides.

    A key that holds more than ``1/share`` of either side's rows is dealt over a grid: rows of the
    left take a row of the grid by ``left_spread`` and are repeated for its columns, rows of the
    right the other way round. There are fewer than ``2 * share`` such keys; their sizes are staged
    and broadcast, and all pairs are found once. Both sides are read twice, the first time for the key alone.
    """
    keys = left.select(key, F.lit(1).alias("_left"), F.lit(0).alias("_right")).unionByName(
        right.select(key, F.lit(0).alias("_left"), F.lit(1).alias("_right"))
    )
    sizes = keys.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum("_left").alias("_left"), F.sum("_right").alias("_right"))
    cells = lambda name, side: F.ceil(F.col(name) * share / side.agg(F.count(F.lit(1))).scalar()).cast("int")
    met = sizes.where("_left > 0 and _right > 0").select(F.col(key).alias("_hot"), cells("_left", left).alias("_rows"), cells("_right", right).alias("_columns"))
    hot = stage(met.where("_rows > 1 or _columns > 1"), "hot-keys")

    def placed(side: DataFrame, spread: Column, own: str, other: str) -> DataFrame:
        dealt = side.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
        number = F.pmod(F.xxhash64(spread), F.coalesce(own, F.lit(1))).cast("int")
        repeated = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))
        return dealt.select(*side.columns, number.alias(f"{own}_at"), repeated.alias(f"{other}_at"))

    cell = [key, "_rows_at", "_columns_at"]
    return placed(left, left_spread, "_rows", "_columns").join(placed(right, right_spread, "_columns", "_rows"), cell).drop(*cell[1:])


def bit_filter(keys: DataFrame, key: str) -> Callable[[Column], Column]:
    """A row-local test in front of a join: true for every value of ``key`` and for few others.

    Each key sets two bits of a table whose size is bounded whatever the number of keys (it holds
    words of 32 bits, which are fetched and sent with the tasks). With more keys than it has room for
    it lets more through, and the join that follows decides as before. ``keys`` is read twice.
    """
    bits = min(MOST_FILTER_BITS, max(LEAST_FILTER_BITS, (16 * keys.count()).bit_length()))

    def places(value: Column) -> list[Column]:
        hashed = F.xxhash64(value)
        return [F.shiftrightunsigned(hashed, 64 - bits), hashed.bitwiseAND(F.lit((1 << bits) - 1))]

    word, bit = lambda place: F.shiftright(place, 5).cast("int"), lambda place: place.bitwiseAND(F.lit(31)).cast("int")
    place = keys.where(F.col(key).isNotNull()).select(F.explode(F.array(*places(F.col(key)))).alias("place"))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit(F.col("place")))
    words = [0] * (1 << bits - 5)
    for row in place.groupBy(word(F.col("place")).alias("word")).agg(F.bit_or(one).alias("bits")).collect():
        words[row["word"]] = row["bits"]
    table = F.from_json(F.lit(str(words)), "array<bigint>")

    def test(value: Column) -> Column:
        one, two = [F.call_function("shiftright", F.get(table, word(p)), bit(p)).bitwiseAND(F.lit(1)) == 1 for p in places(value)]
        return one & two

    return test
