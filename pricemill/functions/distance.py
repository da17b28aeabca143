"""Edit distance with adjacent transpositions, as expressions over machine words.

One column of the distance table is a few 64-bit numbers: bit ``i`` tells whether the distance rises
or falls from row ``i`` to row ``i + 1`` (Hyyrö's bit vectors for optimal string alignment). A character of
the longer word costs a handful of operations for every 60 characters of the shorter one.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pricemill.functions.text import let

# Characters of a block; the sum of two blocks stays within a bigint.
BITS = 60
FULL = (1 << BITS) - 1


def _long(value) -> Column:
    return F.lit(value).cast("bigint")


def characters(word: Column) -> Column:
    """The characters (code points) of a word."""
    each = F.transform(F.sequence(F.lit(1), F.char_length(word)), lambda i: F.substring(word, i, F.lit(1)))
    return F.when(F.char_length(word) > 0, each).otherwise(F.array().cast("array<string>"))


def _masks(pattern: Column, blocks: Column, character: Column) -> Column:
    """Per block, the places of the pattern that hold ``character``."""

    def block(k: Column) -> Column:
        bits = F.transform(
            F.slice(pattern, k * BITS + 1, BITS),
            lambda c, i: F.when(c == character, F.call_function("shiftleft", _long(1), i)).otherwise(_long(0)),
        )
        return F.aggregate(bits, _long(0), lambda a, b: a + b)

    return F.transform(blocks, block)


def _flip(value: Column) -> Column:
    return value.bitwiseXOR(_long(FULL))


def _up(value: Column, carry: Column) -> Column:
    """Every bit one place higher, ``carry`` at the lowest."""
    return F.shiftleft(value, 1).bitwiseOR(carry).bitwiseAND(_long(FULL))


def _block(acc: Column, old: Column, mask: Column, last: Column, is_last: Column) -> Column:
    """One block of a column of the table, after the blocks below it."""
    above = lambda value: F.shiftright(value, BITS - 1)
    swapped = F.shiftleft(_flip(old["d0"]).bitwiseAND(mask), 1).bitwiseOR(above(_flip(acc["d0"]).bitwiseAND(acc["pm"])))
    matched = mask.bitwiseOR(acc["hn"])
    spread = (matched.bitwiseAND(old["vp"]) + old["vp"]).bitwiseXOR(old["vp"])
    diagonal = spread.bitwiseOR(matched).bitwiseOR(old["vn"]).bitwiseOR(swapped.bitwiseAND(old["pm"])).bitwiseAND(_long(FULL))

    def horizontal(d: Column) -> Column:
        rises = old["vn"].bitwiseOR(_flip(d.bitwiseOR(old["vp"])))
        return let(F.struct(rises.alias("up"), d.bitwiseAND(old["vp"]).alias("down")), lambda h: vertical(d, h))

    def vertical(d: Column, h: Column) -> Column:
        bit = lambda value: F.call_function("shiftright", value, last).bitwiseAND(_long(1))
        change = F.when(is_last, bit(h["up"]) - bit(h["down"])).otherwise(_long(0))
        moved = F.struct(_up(h["up"], acc["hp"]).alias("up"), _up(h["down"], acc["hn"]).alias("down"))
        return let(moved, lambda m: F.struct(
            F.array_append(acc["done"], F.struct(
                m["down"].bitwiseOR(_flip(d.bitwiseOR(m["up"]))).alias("vp"), m["up"].bitwiseAND(d).alias("vn"),
                d.alias("d0"), mask.alias("pm"),
            )).alias("done"),
            above(h["up"]).alias("hp"), above(h["down"]).alias("hn"), old["d0"].alias("d0"), mask.alias("pm"),
            (acc["score"] + change).alias("score"),
        ))

    return let(diagonal, horizontal)


_COLUMN = "struct<done:array<struct<vp:bigint,vn:bigint,d0:bigint,pm:bigint>>,hp:bigint,hn:bigint,d0:bigint,pm:bigint,score:bigint>"


def _aligned(pattern: Column, text: Column) -> Column:
    """The distance of a pattern of at least one character and a text, both as characters."""

    def prepared(p: Column) -> Column:
        size = F.size(p)
        blocks = F.sequence(F.lit(0), F.floor((size - 1) / BITS).cast("int"))
        alphabet = F.array_distinct(p)
        return F.struct(
            size.alias("size"), blocks.alias("blocks"), alphabet.alias("alphabet"),
            F.transform(alphabet, lambda c: _masks(p, blocks, c)).alias("masks"),
            F.transform(blocks, lambda k: _long(0)).alias("none"),
        )

    def run(p: Column) -> Column:
        fresh = F.struct(_long(FULL).alias("vp"), _long(0).alias("vn"), _long(0).alias("d0"), _long(0).alias("pm"))
        column = lambda done, score: F.struct(
            done.alias("done"), _long(1).alias("hp"), _long(0).alias("hn"), _long(0).alias("d0"), _long(0).alias("pm"), score.alias("score")
        ).cast(_COLUMN)
        last = F.pmod(p["size"] - 1, F.lit(BITS))

        def step(state: Column, c: Column) -> Column:
            place = F.array_position(p["alphabet"], c).cast("int")
            masks = F.when(place > 0, F.get(p["masks"], place - 1)).otherwise(p["none"])
            empty = F.array().cast("array<struct<vp:bigint,vn:bigint,d0:bigint,pm:bigint>>")
            return let(masks, lambda m: F.aggregate(
                p["blocks"], column(empty, state["score"]),
                lambda acc, k: _block(acc, F.get(state["done"], k), F.get(m, k), last, k == F.size(p["blocks"]) - 1).cast(_COLUMN),
            ))

        first = column(F.transform(p["blocks"], lambda k: fresh), p["size"].cast("bigint"))
        return F.aggregate(text, first, step, lambda s: s["score"].cast("int"))

    return let(prepared(pattern), run)


def _osa(left: Column, right: Column) -> Column:
    short_left = F.char_length(left) <= F.char_length(right)
    short, long = F.when(short_left, left).otherwise(right), F.when(short_left, right).otherwise(left)
    return F.when(F.char_length(short) == 0, F.char_length(long)).otherwise(_aligned(characters(short), characters(long)))


def osa_distance(left: Column, right: Column, limit: int | None = None) -> Column:
    """Insertions, deletions, substitutions and swaps of neighbours (optimal string alignment).

    The plain edit distance is at most twice this one and equal to it below two, so the built-in
    ``levenshtein`` settles most pairs; only the others are aligned. With a ``limit`` pairs
    farther apart give null.
    """
    if limit is None:
        plain = F.levenshtein(left, right)
    else:
        bounded = F.levenshtein(left, right, 2 * limit)
        plain = F.when(bounded >= 0, bounded)

    def decided(value: Column) -> Column:
        return F.when(value > 1, _osa(left, right)).otherwise(value)

    distance = let(plain, decided)
    return distance if limit is None else let(distance, lambda d: F.when(d <= limit, d))
