"""Quality rules as a short-circuit cascade ordered by rejections per cost.

Each rule is a condition on a text. Cost and selectivity of every rule are estimated on a sample;
then rules run in the order of falling rejection per cost inside one ``CASE``, which stops at the
first rule that rejects. The order changes the cost only, never the verdict.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from pricemill.session import stage

# The separators of words, and the characters counted as symbols.
SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Rows of the sample on which rules are timed. It only decides the order of the rules.
SAMPLE_ROWS = 2000
# How often a timed job repeats the sample's rows and is run, and the least cost that is told apart.
REPEATS = 8
RUNS = 3
LEAST_SECONDS = 1 / 128

MIN_WORDS = 50
MAX_REPEAT_SHARE = 50


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a condition over the text and the base statistics."""

    name: str
    rejects: Column


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), 0)


def _repeat_words(words: Column, n_words: Column) -> Column:
    """Words that lie in a three-word window found at least twice in ``words``."""
    windows = F.when(
        n_words >= 3,
        F.transform(
            F.sequence(F.lit(0), n_words - 3),
            lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(starts: Column) -> Column:
        # windows overlap: each adds the words up to the next repeated window, three at most
        steps = F.transform(starts, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    def repeated_starts(pairs: Column) -> Column:
        equal = lambda pair, i: F.get(pairs, i - 1)["h"].eqNullSafe(pair["h"]) | F.get(pairs, i + 1)["h"].eqNullSafe(pair["h"])
        return F.array_sort(F.transform(F.filter(pairs, equal), lambda pair: pair["i"]))

    def count(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        some = _let(pairs, lambda p: _let(repeated_starts(p), covered))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(some)

    return _let(windows, count)


def base_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Append ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` (bigint).

    A null text has none of anything.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(value, f"{SPACE_CLASS}+"), "")
    with_word = F.filter(F.split(value, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    split = docs.withColumns({"_llm_words": words, "_llm_lines": with_word})
    n_words = F.size("_llm_words")
    return split.withColumns(
        {
            "n_words": n_words.cast("bigint"),
            "word_chars": F.char_length(F.translate(value, SPACES, "")).cast("bigint"),
            "n_symbols": (F.char_length(value) - F.char_length(F.translate(value, SYMBOLS, ""))).cast("bigint"),
            "n_lines_with_word": F.size("_llm_lines").cast("bigint"),
            "n_dup_lines": (F.size("_llm_lines") - F.size(F.array_distinct("_llm_lines"))).cast("bigint"),
            "n_repeat_words": _repeat_words(F.col("_llm_words"), n_words).cast("bigint"),
        }
    ).drop("_llm_words", "_llm_lines")


def base_failed() -> Column:
    """Too few words, or most words inside repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_SHARE * F.col("n_words"))


def default_rules(text: str = "text") -> list[Rule]:
    """The rules beyond the base ones; all are integer comparisons, so verdicts are exact."""
    value = F.coalesce(F.col(text), F.lit(""))
    chars, lines = F.col("word_chars"), F.col("n_lines_with_word")
    upper = F.char_length(value) - F.char_length(F.translate(value, UPPER, ""))
    letters = F.char_length(F.regexp_replace(value, "[^\\p{L}]+", ""))
    return [
        Rule("symbols", 100 * F.col("n_symbols") > 10 * chars),
        Rule("capitals", 100 * upper > 50 * chars),
        Rule("letters", 100 * letters < 60 * chars),
        Rule("long_words", chars > 15 * F.col("n_words")),
        Rule("short_words", chars < 2 * F.col("n_words")),
        Rule("dup_lines", 100 * F.col("n_dup_lines") > 50 * lines),
        Rule("bullets", 100 * F.regexp_count(value, F.lit("(?m)^[ \\t]*[-•]")) > 90 * lines),
        Rule("ellipses", 100 * F.regexp_count(value, F.lit("(?m)(?:\\.\\.\\.|…)[ \\t]*$")) > 30 * lines),
        Rule("placeholder", F.contains(F.translate(value, UPPER, UPPER.lower()), F.lit("lorem ipsum"))),
    ]


def rule_costs(sample: DataFrame, rules: list[Rule]) -> dict[str, float]:
    """Seconds of each rule over the sample, beyond those of a job that runs no rule.

    Rows are repeated, so that a rule outweighs the start of its job; the shortest of some runs counts, and
    costs are rounded to powers of two, for the clock tells no more.
    """
    again = sample.withColumn("_llm_again", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

    def seconds(condition: Column) -> float:
        best = math.inf
        for _ in range(RUNS):
            started = time.perf_counter()
            again.agg(F.count_if(condition)).first()
            best = min(best, time.perf_counter() - started)
        return best

    empty = seconds(F.col("_llm_again") < 0)
    return {r.name: 2.0 ** round(math.log2(max(LEAST_SECONDS, seconds(r.rejects) - empty))) for r in rules}


def order_rules(measured: DataFrame, rules: list[Rule], key: str, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Sort by rejection per cost, both measured on a sample of about ``sample_rows`` rows of ``measured``.

    The sample is a share of the keys, chosen by a hash, from all files; its bound holds for rows of one key, too.
    Equal ratios go by cost, then by name.
    """
    share = max(1, measured.select(key).count() // sample_rows)
    chosen = measured.where(F.pmod(F.xxhash64(key, F.lit("rules")), F.lit(share)) == 0).limit(2 * sample_rows)
    sample = stage(chosen, "rule-sample")
    hits = sample.agg(*[F.count_if(r.rejects).alias(r.name) for r in rules]).first()
    cost = rule_costs(sample, rules)
    return sorted(rules, key=lambda r: (-hits[r.name] / cost[r.name], cost[r.name], r.name))


def rule_cascade(
    docs: DataFrame, key: str = "doc_id", text: str = "text", rules: list[Rule] | None = None,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Append the base statistics, ``base_failed``, ``rejected_by`` and ``kept``.

    ``rejected_by`` names the first rule of the cascade that rejects, ``base`` for the base rules
    and null for kept rows; filter by :func:`pricemill.llm.columns.keep_only`. A document without words fails the base rules. Rows keep their other
    columns; ties and repeated rows are judged alike.
    """
    measured = base_statistics(docs, text)
    ordered = order_rules(measured, rules if rules is not None else default_rules(text), key, sample_rows)
    first = F.when(base_failed(), F.lit("base"))
    for rule in ordered:
        first = first.when(rule.rejects, F.lit(rule.name))
    judged = measured.withColumns({"base_failed": base_failed(), "rejected_by": first})
    return judged.withColumn("kept", F.col("rejected_by").isNull())
