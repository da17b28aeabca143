"""Row replication and repeatable text noise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pricemill.functions.text import let


def replicate_rows(df: DataFrame, copies: int, head: int, row_id: str = "row_id", name: str = "copy_id") -> DataFrame:
    """``copies`` copies of every row and one more of the ``head`` rows with the smallest ids; the new id
    ``row_id * (copies + 1) + copy`` is unique without numbering all rows."""
    bound = df.select(row_id).orderBy(row_id).limit(head).agg(F.max(row_id)).scalar()
    last = F.when(F.col(row_id) <= bound, F.lit(copies)).otherwise(F.lit(copies - 1))
    copied = df.withColumn("_copy", F.explode(F.sequence(F.lit(0), last)))
    return copied.withColumn(name, F.col(row_id) * (copies + 1) + F.col("_copy")).drop("_copy")


def hashed_draw(row_id: Column, position: Column, seed: int, modulus: int) -> Column:
    """A repeatable draw in ``[0, modulus)``."""
    return F.pmod(F.xxhash64(row_id, position, F.lit(seed)), F.lit(modulus))


def modular_draw(row_id: Column, position: Column, seed: int, modulus: int) -> Column:
    """The same from plain integer arithmetic, for engines without the hash function."""
    return F.pmod(row_id * 31 + position * 17 + F.lit(seed), F.lit(modulus))


def corrupt_tokens(
    df: DataFrame,
    column: str,
    rate: int,
    modulus: int = 100,
    seed: int = 7,
    row_id: str = "row_id",
    draw=hashed_draw,
) -> DataFrame:
    """Replace about ``rate`` in ``modulus`` tokens by made-up words ``w<number>``; the draw
    depends on row, place and seed only, so reruns and retried tasks give the same text."""

    def noise(tokens: Column) -> Column:
        picked = lambda i: draw(F.col(row_id), i.cast("bigint"), seed, modulus)
        salt = lambda i: F.concat(F.lit("w"), draw(F.col(row_id), i.cast("bigint"), seed + 1, 100_003).cast("string"))
        return F.transform(tokens, lambda t, i: F.when(picked(i) < rate, salt(i)).otherwise(t))

    return df.withColumn(column, F.array_join(let(F.split(F.col(column), " ", -1), noise), " "))


def corrupt_one_token(
    df: DataFrame, column: str, seed: int = 7, row_id: str = "row_id", draw=hashed_draw
) -> DataFrame:
    """Replace exactly one token per row."""

    def noise(tokens: Column) -> Column:
        place = F.pmod(draw(F.col(row_id), F.lit(0).cast("bigint"), seed, 1_000_003), F.size(tokens))
        salt = F.concat(
            F.lit("w"), draw(F.col(row_id), F.lit(1).cast("bigint"), seed + 1, 100_003).cast("string")
        )
        return F.transform(tokens, lambda t, i: F.when(i == place, salt).otherwise(t))

    return df.withColumn(column, F.array_join(let(F.split(F.col(column), " ", -1), noise), " "))
