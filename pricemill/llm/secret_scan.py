"""Secret scan: base patterns, and character Markov models of random strings and ordinary identifiers.

Both models are tables of log probabilities of a character given the one before. They are trained
on labelled samples: words of the corpus are ordinary, hash digests in the usual alphabets are
random. A long token is a secret if its mean log-likelihood ratio per character exceeds a threshold.
Everything is a column expression: positions of matches are sums of the lengths of the parts between them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

# The base patterns in the order in which kinds are listed.
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
ASSIGN_CHARS = 8
KINDS = ["assign", "access", "hex", "random"]

# Tokens that the models judge.
TOKEN_CHARS = 20
TOKEN = f"[A-Za-z0-9+/_=-]{{{TOKEN_CHARS},}}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
# Rows whose words train the ordinary model, and strings of each alphabet for the random one.
SAMPLE_ROWS = 2000
THRESHOLD = 0.7

Model = list[float]


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    """[(start, end, part)] of all matches; ``part`` is the given group."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    between = F.split(text, pattern, -1)
    triples = F.arrays_zip(between.alias("gap"), found.alias("match"), parts.alias("part"))
    start = lambda all_, gap: F.coalesce(F.element_at(all_, -1)["end"], F.lit(0)) + F.char_length(gap)
    empty = F.array().cast("array<struct<start:int,end:int,part:string>>")
    add = lambda all_, x: F.when(x["match"].isNull(), all_).otherwise(
        F.concat(
            all_,
            F.array(
                F.struct(
                    start(F.when(F.size(all_) > 0, all_), x["gap"]).alias("start"),
                    (start(F.when(F.size(all_) > 0, all_), x["gap"]) + F.char_length(x["match"])).alias("end"),
                    x["part"].alias("part"),
                )
            ),
        )
    )
    return F.aggregate(triples, empty, add)


def _found(may: Column, text: Column, pattern: str, group: int = 0) -> Column:
    """Matches, looked for only in texts that may have some."""
    return F.when(may, _matches(text, pattern, group)).otherwise(
        F.array().cast("array<struct<start:int,end:int,part:string>>")
    )


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Log-likelihood ratios of all pairs of characters, row by row of :data:`ALPHABET`.

    The sample is bounded by ``sample_rows``; without rows all pairs of a model are alike.
    """
    sample = docs.where(F.pmod(F.xxhash64(key), F.lit(8)) == 0).limit(sample_rows)
    words = sample.select(F.explode(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9+/_=-]{3,}"), F.lit(0))).alias("token"))
    ids = docs.sparkSession.range(sample_rows)
    digest = F.sha2(F.col("id").cast("string"), 256)
    raw = F.base64(F.unhex(digest))
    strings = [raw, F.translate(raw, "+/", "-_"), F.regexp_replace(raw, "[+/=]", ""), digest, F.upper(F.regexp_replace(raw, "[+/=]", ""))]
    random = ids.select(F.explode(F.array(*strings)).alias("token"))
    both = words.select("token", F.lit(0).alias("label")).unionByName(random.select("token", F.lit(1).alias("label")))
    spots = F.sequence(F.lit(1), F.char_length("token") - 1)
    pairs = both.select("label", F.explode(F.transform(spots, lambda i: F.substring("token", i, F.lit(2)))).alias("pair"))
    counted = pairs.groupBy("label", "pair").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 2 * 67 * 67 rows
    n = len(ALPHABET)
    logs = []
    for label in (0, 1):
        counts = [[0.5] * n for _ in range(n)]
        for row in counted:
            if row["label"] == label:
                counts[ALPHABET.index(row["pair"][0])][ALPHABET.index(row["pair"][1])] += row["n"]
        logs.append([math.log(c / sum(line)) for line in counts for c in line])
    return [round(r - o, 6) for o, r in zip(*logs, strict=True)]


def _ratio(token: Column, model: Model) -> Column:
    """Mean log-likelihood ratio of random to ordinary, per pair of characters."""
    table = F.lit(model)
    place = lambda i: F.instr(F.lit(ALPHABET), F.substring(token, i, F.lit(1))) - 1
    total = F.aggregate(
        F.sequence(F.lit(1), F.char_length(token) - 1), F.lit(0.0),
        lambda sum_, i: sum_ + F.get(table, place(i) * len(ALPHABET) + place(i + 1)),
    )
    return total / (F.char_length(token) - 1)


def _spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    text = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), text), ",")


def find_secrets(
    docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, model: Model | None = None
) -> DataFrame:
    """Append ``base_spans`` and ``spans``, arrays of (start, kind, end) in code points.

    Kinds are the places in :data:`KINDS`. Random tokens that touch a base span are not added, all
    base spans stay. A null text counts as empty and has no spans; repeated rows have equal ones.
    """
    model = model or train(docs, key, text)
    value = F.coalesce(F.col(text), F.lit(""))
    assigned = F.filter(
        _found(F.contains(value, F.lit("=")) | F.contains(value, F.lit(":")), value, ASSIGN, 2),
        lambda m: F.char_length(m["part"]) >= ASSIGN_CHARS,
    )
    access = _found(F.contains(value, F.lit("AKIA")), value, ACCESS)
    long = F.col("_llm_long")
    base = F.concat(_spans(F.col("_llm_assign"), 0), _spans(F.col("_llm_access"), 1), _spans(F.col("_llm_hex"), 2))
    found = (
        docs.withColumn("_llm_long", value.rlike(TOKEN))
        .withColumns({"_llm_assign": assigned, "_llm_access": access, "_llm_hex": _found(long, value, HEX), "_llm_tokens": _found(long, value, TOKEN)})
        .withColumn("base_spans", F.array_sort(base))
    )
    apart = lambda t: ~F.exists(F.col("base_spans"), lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"]))
    random = F.filter("_llm_tokens", lambda t: apart(t) & (_ratio(t["part"], model) > threshold))
    return found.withColumn("spans", F.array_sort(F.concat("base_spans", _spans(random, 3)))).drop(
        "_llm_long", "_llm_assign", "_llm_access", "_llm_hex", "_llm_tokens"
    )


def span_text(spans: str) -> Column:
    """Spans as ``kind:start:end``, by start and kind, joined by commas."""
    return _joined(F.col(spans))


def mask_secrets(found: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """Replace the spans of :func:`find_secrets` in the text; overlapping ones become one."""
    value = F.coalesce(F.col(text), F.lit(""))
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda s, x: F.when(x["end"] <= s["at"], s).otherwise(
        F.struct(
            F.concat(s["out"], F.when(x["start"] >= s["at"], F.concat(F.substring(value, s["at"] + 1, x["start"] - s["at"]), F.lit(mask))).otherwise("")).alias("out"),
            x["end"].alias("at"),
        )
    )
    masked = F.aggregate("spans", state, step, lambda s: F.concat(s["out"], F.substring(value, s["at"] + 1, F.char_length(value))))
    return found.withColumn(text, F.when(F.size("spans") > 0, masked).otherwise(F.col(text)))
