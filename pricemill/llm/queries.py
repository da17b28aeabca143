"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from public_tokenizers import PATTERN, path
from pyspark.sql import DataFrame, SparkSession, functions as F

from pricemill.catalog.registry import Catalog
from pricemill.llm.decontaminate import LEAST_PERCENT, LEAST_TOKENS, contamination
from pricemill.llm.hard_negatives import hard_negatives
from pricemill.llm.line_dedup import build_index, drop_repeated_lines
from pricemill.llm.near_dedup import near_duplicates
from pricemill.llm.packing import pack
from pricemill.llm.pseudonyms import pseudonymize_texts
from pricemill.llm.quality_rules import rule_cascade
from pricemill.llm.secret_scan import find_secrets, span_text
from pricemill.llm.sharding import shard_by_bytes
from pricemill.llm.toxicity import toxicity, training_fold
from pricemill.llm.vector_dedup import near_duplicate_vectors
from pricemill.llm.warc import read_archives, write_archives
from pricemill.llm.whitening import whiten

LLM = Catalog()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@LLM.query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = toxicity(documents(spark, sf_dir).select("doc_id", "text"), labels)
    return scored.select(
        "doc_id", (training_fold("doc_id") == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


OP3_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents
),
sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] ELSE list_distinct(list_transform(
           range(1, greatest(2, len(words) - 3)), lambda i: array_to_string(words[i:i + 4], ' '))) END AS shingles
  FROM docs
),
posted AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS both_
  FROM posted a JOIN posted b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
),
links AS (SELECT a, b FROM common WHERE 100 * both_ >= 85 * (na + nb - both_)),
reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM docs
  UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.seen = l.a
)
SELECT s.doc_id, len(s.shingles) AS n_shingles, min(r.seen) AS component_id, min(r.seen) = s.doc_id AS kept
FROM sets s JOIN reach r ON r.node = s.doc_id GROUP BY s.doc_id, s.shingles
"""


@LLM.query("op3_minhash_near_dedup", OP3_SQL)
def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
    return linked.select("doc_id", "n_shingles", "component_id", "kept")


OP4_SQL = """
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
spread AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM docs
),
keyed AS (
  SELECT doc_id, line, pos,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM spread
),
repeated AS (
  SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
),
judged AS (
  SELECT k.doc_id, k.line, k.pos, coalesce(k.doc_id <> r.first_doc, false) AS dropped
  FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@LLM.query("op4_line_dedup", OP4_SQL)
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    kept = drop_repeated_lines(docs, build_index(docs, batches=2))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
),
spread AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM docs),
windows AS (
  SELECT doc_id, i, w, lead(w, 1) OVER d AS w2, lead(w, 2) OVER d AS w3 FROM spread
  WINDOW d AS (PARTITION BY doc_id ORDER BY i)
),
repeated AS (
  SELECT doc_id, i FROM windows WHERE w3 IS NOT NULL
  QUALIFY count(*) OVER (PARTITION BY doc_id, w, w2, w3) >= 2
),
covered AS (
  SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS pos FROM repeated) GROUP BY doc_id
),
base AS (
  SELECT d.doc_id, text, len(words) AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words
  FROM docs d LEFT JOIN covered c USING (doc_id)
),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         100 * n_symbols > 10 * word_chars
         OR 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 50 * word_chars
         OR 100 * length(regexp_replace(text, '[^\p{L}]', '', 'g')) < 60 * word_chars
         OR word_chars > 15 * n_words OR word_chars < 2 * n_words
         OR 100 * n_dup_lines > 50 * n_lines
         OR 100 * len(regexp_extract_all(text, '(?m)^[ \t]*[-•]')) > 90 * n_lines
         OR 100 * len(regexp_extract_all(text, '(?m)(?:\.\.\.|…)[ \t]*$')) > 30 * n_lines
         OR contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'lorem ipsum') AS rejected
  FROM base
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT rejected AS kept
FROM judged
"""


@LLM.query("op5_quality_rules", OP5_SQL)
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rule_cascade(documents(spark, sf_dir).select("doc_id", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@LLM.query("op2_packing")
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    pieces = pack(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), PATTERN)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


# All alignments: a diagonal with fewer equal tokens than the shortest stretch needs holds none, and a
# stretch of twice LEAST_TOKENS or more has a half that is as good.
OP6_SQL = rf"""
WITH doc_words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS words
  FROM documents WHERE doc_id IS NOT NULL
),
item_words AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS words
  FROM benchmark
),
doc_tokens AS (SELECT doc_id, len(words) AS n, unnest(words) AS word, generate_subscripts(words, 1) AS at FROM doc_words),
item_tokens AS (
  SELECT item_id, len(words) AS n, unnest(words) AS word, generate_subscripts(words, 1) AS at FROM item_words
  WHERE len(words) >= {LEAST_TOKENS}
),
diagonals AS (
  SELECT doc_id, item_id, d.at - i.at AS shift, list(d.at) AS places, any_value(d.n) AS n_doc, any_value(i.n) AS n_item
  FROM doc_tokens d JOIN item_tokens i ON d.word = i.word
  GROUP BY ALL HAVING 100 * count(*) >= {LEAST_PERCENT * LEAST_TOKENS}
),
starts AS (
  SELECT doc_id, item_id, places, n, unnest(range(greatest(1, 1 + shift), least(n_doc, n_item + shift) - n + 2)) AS first
  FROM diagonals, range({LEAST_TOKENS}, {2 * LEAST_TOKENS}) AS lengths(n)
),
stretches AS (
  SELECT doc_id, item_id, n, len(list_filter(places, lambda p: p >= first AND p < first + n)) AS equal FROM starts
)
SELECT doc_id, item_id, max(equal) AS overlap FROM stretches WHERE 100 * equal >= {LEAST_PERCENT} * n GROUP BY doc_id, item_id
"""


@LLM.query("op6_decontamination", OP6_SQL)
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination(documents(spark, sf_dir).select("doc_id", "text"), benchmark)


@LLM.query("op7_pseudonyms")
def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a key of the demonstration; real ones come from a secret store
    return pseudonymize_texts(documents(spark, sf_dir).select("doc_id", "text"), b"pricemill demonstration key")


OP8_SQL = """
WITH sized AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages
),
latest AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM sized
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM latest
"""


@LLM.query("op8_warc", OP8_SQL)
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_archives(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@LLM.query("op9_secret_scan")
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(span_text("base_spans"), 256).alias("base_sha256"), span_text("spans").alias("spans"),
    )


@LLM.query("op10_sharding")
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = shard_by_bytes(documents(spark, sf_dir).select("doc_id", "text"))
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    return sharded.select(
        "doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


_SOUND = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

OP11_SQL = f"""
WITH RECURSIVE rows AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v,
         label IS NOT NULL AND {_SOUND} AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS sound
  FROM embeddings
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM rows a JOIN rows b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.sound AND b.sound AND list_cosine_similarity(a.v, b.v) >= 0.93
),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a),
reach AS (
  SELECT vec_id AS node, vec_id AS seen FROM rows
  UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.seen = l.a
),
least AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM rows JOIN least ON node = vec_id LEFT JOIN counts ON a = vec_id
"""


@LLM.query("op11_vector_dedup", OP11_SQL)
def op11_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
    return linked.select("vec_id", "n_links", "component_id", "kept")


OP12_SQL = f"""
WITH rows AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND {_SOUND}
),
scored AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM rows a JOIN rows b ON a.id <> b.id WHERE a.id % 100 = 0
),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER best AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN (SELECT * FROM scored WHERE NOT same) USING (anchor_id)
WHERE 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER best <= 10
"""


@LLM.query("op12_hard_negatives", OP12_SQL)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.pmod("vec_id", F.lit(7)) == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    return hard_negatives(vectors, F.pmod("vec_id", F.lit(100)) == 0, label)


@LLM.query("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return made.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
