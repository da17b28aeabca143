"""From raw documents to packed training sequences: five stages, each written as parquet and reread.

1. quality rules: documents that a rule rejects go;
2. line dedup: lines that an earlier document holds already are taken out of the text;
3. near-dedup: one document of each group of near-duplicates stays;
4. benchmark decontamination: documents that overlap a benchmark item go;
5. packing: pieces of documents in full sequences at the corpus's own mixture of sources.

Every stage works on all rows that the one before it kept.
"""

from __future__ import annotations

from public_tokenizers import PATTERN, path
from pyspark.sql import DataFrame, SparkSession, functions as F

from pricemill.llm.columns import keep_only
from pricemill.llm.decontaminate import drop_contaminated
from pricemill.llm.line_dedup import build_index, drop_repeated_lines
from pricemill.llm.near_dedup import drop_near_duplicates
from pricemill.llm.packing import pack
from pricemill.llm.quality_rules import rule_cascade
from pricemill.session import stage

# Tokens depend on a vocabulary and windows on counts of tokens, which SQL can't express.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return keep_only(rule_cascade(docs), "kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a document with a smaller id holds; ``n_chars`` follows the text."""
    kept = drop_repeated_lines(docs, build_index(docs))
    changed = kept.withColumns({"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("bigint")})
    return changed.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group linked by a similarity of 0.8 or more."""
    return drop_near_duplicates(docs, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no item of the benchmark."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    pieces = pack(docs.select("doc_id", "text", "source"), path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), PATTERN)
    return pieces.select(
        "doc_id", "source", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near-dedup", near_copies),
    ("benchmark decontamination", benchmark),
    ("packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table; the result is that of the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
