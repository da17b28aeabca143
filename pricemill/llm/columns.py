"""Column names of inputs and results, and a filter that stays where it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def free(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` without columns that a result is about to add under the same names."""
    return docs.drop(*names)


def keep_only(docs: DataFrame, flag: str) -> DataFrame:
    """Rows whose boolean column ``flag`` is true.

    The flag is read behind a generator, so the optimizer cannot move the filter below the projections
    that made it; there it would put their expressions into each other and evaluate them again for
    every use, words even for every word.
    """
    read = docs.withColumn("_llm_keep", F.explode_outer(F.when(F.col(flag), F.array(F.lit(True)))))
    return read.where(F.col("_llm_keep").isNotNull()).drop("_llm_keep")
