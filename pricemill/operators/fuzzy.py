"""Fuzzy dictionary lookup by shared segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pricemill.functions.distance import osa_distance
from pricemill.functions.text import find_tokens, let
from pricemill.operators.joins import grid_match
from pricemill.session import stage

BEST, CLOSEST, ALL = 0, 1, 2


def term_dictionary(df: DataFrame, column: str, pattern: str = "[a-z]+") -> DataFrame:
    """``(term, n)``: tokens of the lower-cased column and how often they occur."""
    terms = df.select(F.explode(find_tokens(F.lower(F.col(column)), pattern)).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def delete_variants(word: Column, deletions: int, prefix: int) -> Column:
    """The first ``prefix`` characters of a word with up to ``deletions`` characters left out,
    distinct and never empty.

    A word gives at most ``sum(C(prefix, i), i <= d)`` variants however long it is, and no length is
    excluded.
    """

    def shorter(w: Column) -> Column:
        drop = lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w)))
        return F.when(F.length(w) > 1, F.transform(F.sequence(F.lit(1), F.length(w)), drop)).otherwise(
            F.array().cast("array<string>")
        )

    variants = F.array(F.substring(word, 1, prefix))
    for _ in range(deletions):
        variants = let(
            variants,
            lambda level: F.array_distinct(F.concat(level, F.flatten(F.transform(level, shorter)))),
        )
    return variants


def _with_segments(words: DataFrame, word: str, probes: list[tuple[int, int, int]], segments: int) -> DataFrame:
    """Every word with every probe ``(more, place, shift)``, and start (from zero) and size of that even segment
    of a word that is ``more`` characters shorter. Plain columns, since one expression over all probes would be too
    long to be compiled."""
    table = F.array(*[F.struct(F.lit(m).alias("more"), F.lit(p).alias("place"), F.lit(s).alias("shift")) for m, p, s in probes])
    rows = words.withColumn("size", F.char_length(word)).select("*", F.inline(table)).withColumn("length", F.col("size") - F.col("more"))
    start = F.expr(f"int(length * place div {segments})")
    end = F.expr(f"int(length * (place + 1) div {segments})")
    return rows.where(F.col("length") >= segments).withColumns({"start": start, "width": end - start})


def _key(text: Column) -> Column:
    return F.xxhash64("length", "place", text).alias("segment")


def term_segments(terms: DataFrame, distance: int) -> DataFrame:
    """``(term, n, segment)``: the keys under which a dictionary word is found, its ``distance + 1`` even segments, each with
    the word's length and the segment's place.

    Every edit is counted to one segment, a swap across a border to the left one; so one segment of
    ``distance + 1`` is free. The query holds it as it is, or with the last character of the
    segment before in place of its first one (that swap); both are keys. Words of at most ``distance``
    characters have no such segments; their keys are their characters.
    """
    probes = [(0, place, swap) for place in range(distance + 1) for swap in (0, 1) if place or not swap]
    placed = _with_segments(terms, "term", probes, distance + 1)
    before = F.concat(F.substring("term", F.col("start"), F.lit(1)), F.substring("term", F.col("start") + 2, F.col("width") - 1))
    text = F.when(F.col("shift") == 0, F.substring("term", F.col("start") + 1, F.col("width"))).otherwise(before)
    short = terms.withColumns({"length": F.char_length("term"), "place": F.lit(-1)}).where(F.col("length") <= distance)
    letters = short.select("*", F.explode(F.array_distinct(F.split("term", ""))).alias("letter"))
    return placed.select("term", "n", _key(text)).unionByName(letters.select("term", "n", _key(F.col("letter"))))


def query_segments(words: DataFrame, distance: int) -> DataFrame:
    """``(query, segment)``: the keys of all dictionary words that may be within ``distance`` of a query.

    For every length a word may have, the substrings of the query where a free segment can lie: shifted
    by as much as leaves enough edits to make up the rest of the difference in length.
    """
    probes = [
        (more, place, shift)
        for more in range(-distance, distance + 1)  # characters of the query beyond those of the term
        for place in range(distance + 1)
        for shift in range(-((distance - more) // 2), (distance + more) // 2 + 1)
    ]
    at = F.col("start") + F.col("shift")
    placed = _with_segments(words, "query", probes, distance + 1).where((at >= 0) & (at + F.col("width") <= F.col("size")))
    lengths = F.sequence(F.greatest(F.lit(1), F.char_length("query") - distance), F.lit(distance))
    short = words.where(F.char_length("query") <= 2 * distance).select("query", F.explode(lengths).alias("length"), F.lit(-1).alias("place"))
    letters = short.select("*", F.explode(F.array_distinct(F.split("query", ""))).alias("letter"))
    return placed.select("query", _key(F.substring("query", at + 1, F.col("width")))).unionByName(letters.select("query", _key(F.col("letter"))))


def fuzzy_candidates(queries: DataFrame, dictionary: DataFrame, max_distance: int = 3) -> DataFrame:
    """``(query, term, n, distance)`` of all dictionary terms within ``max_distance`` that share a character.

    Both sides are distinct words, empty ones aside. They meet on segments (an equi-join on 8-byte keys, never all
    pairs); a common segment is dealt over many tasks. Pairs too far apart go before the rest are made distinct.
    """
    words = stage(queries.where("query <> ''").select("query").distinct(), "query-words")
    terms = stage(dictionary.where("term <> ''").select("term", "n"), "terms")
    left, right = query_segments(words, max_distance), term_segments(terms, max_distance)
    pairs = grid_match(left, right, "segment", F.col("query"), F.col("term"))
    near = pairs.where(F.levenshtein("query", "term", 2 * max_distance) >= 0).select("query", "term", "n").distinct()
    measured = near.withColumn("distance", osa_distance(F.col("query"), F.col("term"), max_distance))
    return measured.where(F.col("distance").isNotNull())


def fuzzy_match(
    queries: DataFrame, dictionary: DataFrame, max_distance: int = 3, verbosity: int = BEST
) -> DataFrame:
    """``(query, term, n, distance, place)``: suggestions ordered by distance, then frequency
    (high first), then term. Verbosity 0 keeps the best one, 1 all at the smallest distance, 2 all
    within ``max_distance``."""
    found = fuzzy_candidates(queries, dictionary, max_distance)
    by_query = Window.partitionBy("query").orderBy("distance", F.desc("n"), "term")
    ranked = found.withColumns(
        {"place": F.row_number().over(by_query), "_nearest": F.first("distance").over(by_query)}
    )
    if verbosity == BEST:
        ranked = ranked.where(F.col("place") == 1)
    elif verbosity == CLOSEST:
        ranked = ranked.where(F.col("distance") == F.col("_nearest"))
    return ranked.drop("_nearest")
