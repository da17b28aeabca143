"""Text cleaning, splitting and enrichment as column expressions.

Character classes are written out instead of ``\\w``, ``\\s`` and ``\\d`` so that the meaning is the
Unicode one whatever the regex dialect.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, functions as F

from pricemill.constants import BOILERPLATE_DESCRIPTION, MISSING

# Character classes and patterns that decide the results.
WHITESPACE = "[\\t-\\r\\x{1c}-\\x{20}\\x{85}\\p{Z}]"
WORD_CHAR = "[\\p{L}\\p{N}_]"
NOT_WORD_CHAR = "[^\\p{L}\\p{N}_]"
SPACES = WHITESPACE + "+"
DECIMAL = "([0-9])( *)\\.( *)([0-9])"
KEEP_RUNS = "([a-z]+|[0-9]+)"
WHITELIST_DROP = "[^\\.!?@#&%$/\\\\0-9a-z]"
WHITELIST_ISOLATE = "(\\.|!|\\?|@|#|&|%|\\$|/|\\\\|[0-9]+)"
SMALL_DROP = "[^\\.&%$0-9a-z]"
SMALL_ISOLATE = "(\\.|&|%|[0-9]+)"  # the dollar sign is kept but stays attached
PATH_DROP = "[^0-9a-z&/]"
PATH_ISOLATE = "(&|/|[0-9]+)"
SYMBOL_RUNS = "([a-z]+|[0-9]+|[^0-9a-z])"
KARATS = "(\\p{Nd})(" + WHITESPACE[:-1] + "-]?)(karat|karats|carat|carats|kt)(" + NOT_WORD_CHAR + ")"
UNITS = "(\\p{Nd}+)" + WHITESPACE[:-1] + "-]([a-z]{2})(" + WHITESPACE + ")"
TOKEN = "[a-zA-Z0-9_\\p{L}\\p{N}]{2,}"  # a word of two or more characters; the common ones are tested first


def let(value: Column, body) -> Column:
    """Bind ``value`` to a lambda variable so that ``body`` can use it many times while it is
    computed once per row (the optimizer may otherwise inline it at every use)."""
    return F.transform(F.array(value), body)[0]


def quote(literal: str) -> str:
    """Escape a literal for a regular expression."""
    return re.sub(r"([^0-9A-Za-z_ ])", r"\\\1", literal)


def tidy(text: Column) -> Column:
    """Collapse white space to single spaces and strip."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def _isolate(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, " $1 ")


def _rejoin_decimals(text: Column) -> Column:
    return F.regexp_replace(text, DECIMAL, "$1.$4")


def clean_keep(text: Column) -> Column:
    """Lower case; letter runs and digit runs apart; decimals rejoined; punctuation stays."""
    return tidy(_rejoin_decimals(_isolate(F.lower(text), KEEP_RUNS)))


def clean_whitelist(text: Column) -> Column:
    """Lower case; keep ``. ! ? @ # & % $ / \\``, digits and a-z; symbols and digit runs apart."""
    kept = F.regexp_replace(F.lower(text), WHITELIST_DROP, " ")
    return tidy(_rejoin_decimals(_isolate(kept, WHITELIST_ISOLATE)))


def clean_small(text: Column) -> Column:
    """As :func:`clean_whitelist` with only ``. & % $`` kept; the dollar sign is not isolated."""
    kept = F.regexp_replace(F.lower(text), SMALL_DROP, " ")
    return tidy(_rejoin_decimals(_isolate(kept, SMALL_ISOLATE)))


def clean_path(text: Column) -> Column:
    """Keep a-z, digits, ``&`` and ``/``; no decimal rejoining."""
    return tidy(_isolate(F.regexp_replace(F.lower(text), PATH_DROP, " "), PATH_ISOLATE))


def clean_symbols(text: Column) -> Column:
    """Every symbol apart, letter and digit runs apart, decimals rejoined."""
    return tidy(_rejoin_decimals(_isolate(F.lower(text), SYMBOL_RUNS)))


def lower_or_empty(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def blank_boilerplate(text: Column, boilerplate: str = BOILERPLATE_DESCRIPTION) -> Column:
    """Empty a description that is only the boilerplate phrase, whatever its case."""
    return F.when(F.lower(F.trim(text)) == boilerplate.lower(), F.lit("")).otherwise(text)


def category_levels_2(path: Column, missing: str = MISSING) -> tuple[Column, Column]:
    """First and second level of a category path; a missing second level becomes ``missing``."""
    parts = F.split(path, "/", -1)
    return F.trim(F.get(parts, F.lit(0))), F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit(missing)))


def category_levels_3(path: Column) -> dict[str, Column]:
    """Three levels and ``level1/level2``; a path with fewer than three levels is all ``other``."""
    parts = F.split(path, "/", -1)
    deep = F.size(parts) >= 3

    def level(i: int) -> Column:
        return F.when(deep, F.get(parts, F.lit(i))).otherwise("other")

    return {
        "general_cat": level(0),
        "subcat_1": level(1),
        "subcat_2": level(2),
        "gen_subcat1": F.when(deep, F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))).otherwise(
            "other/other"
        ),
    }


def word_length(text: Column, separator: str = " ") -> Column:
    """Number of parts between separators (an empty text has one)."""
    return F.size(F.split(text, quote(separator), -1))


def normalize_units(text: Column) -> Column:
    """``14 karat `` to ``14k ``, then ``8 oz `` to ``8oz ``."""
    return F.regexp_replace(F.regexp_replace(text, KARATS, "$1k$4"), UNITS, "$1$2$3")


def cross_key(left: Column, right: Column) -> Column:
    return F.concat_ws("_", left, right.cast("string"))


def join_texts(texts: Iterable[Column], separator: str = " ") -> Column:
    return F.concat_ws(separator, *texts)


def token_overlap(left: Column, right: Column) -> Column:
    """Shared distinct tokens over distinct tokens of ``left`` plus one."""
    tokens = F.split(left, " ", -1)
    shared = F.size(F.array_intersect(tokens, F.split(right, " ", -1)))
    return shared / (F.size(F.array_distinct(tokens)) + 1)


def find_tokens(text: Column, pattern: str = TOKEN) -> Column:
    """All matches of ``pattern``, left to right."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def spaces_to_underscores(text: Column) -> Column:
    return F.translate(text, " ", "_")


def literal_map(entries: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def replace_aliases(text: Column, aliases: Sequence[tuple[str, str]]) -> Column:
    """Replace phrases in one left-to-right pass; where several match at a place, the one listed
    first wins. Phrases match inside words too. A replacement is never matched again, which a
    chain of ``regexp_replace`` would do."""
    pattern = "|".join(quote(phrase) for phrase, _ in aliases)
    lookup = literal_map(dict(aliases))
    between = F.split(text, pattern, -1)
    replaced = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: lookup[m])
    pieces = F.zip_with(between, replaced, lambda b, r: F.concat(b, F.coalesce(r, F.lit(""))))
    return F.array_join(pieces, "")


def first_keyword_value(text: Column, keywords: Mapping[str, str]) -> Column:
    """Value of the first space-separated token that is a keyword; null if none is."""
    lookup = literal_map(keywords)
    values = F.transform(F.split(text, " ", -1), lambda t: lookup[t])
    return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))
