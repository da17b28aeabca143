"""Toxicity by two class-conditional Kneser-Ney models.

An event is a character of a word given the four before it (the word's beginning and end count as
characters), so insults that were never seen whole are recognised by their parts. Each class has
its own counts of whole events; all that rare events fall back to is shared: the counts of both classes
together, and below them one table of continuation counts. Most words of a toxic text are ordinary, so
its likelihood of a word mixes the toxic model with the ordinary one; a text's value is the mean
over its words of the difference of both log-likelihoods, and a logistic curve turns it into a
probability. The curve is fitted on labelled texts that did not take part in the counts it is
fitted against.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from pricemill.llm.columns import free
from pricemill.llm.spans import mix
from pricemill.session import stage

ORDER = 5
# Events are counted in so many slots, which bounds the model (four tables of 8 MB) whatever the corpus.
SLOTS = 1 << 21
DISCOUNT = 0.75
# Part of the words of a toxic text that the toxic model is expected to explain.
TOXIC_SHARE = 0.005
# Labelled texts that are counted, at most (their ids and labels are broadcast, 24 MB), and those on
# which the logistic curve is fitted. Both are the first by a hash of the id.
TAUGHT_ROWS = 1_000_000
CURVE_ROWS = 20_000
CHUNK = 1 << 19

FACTORS = np.random.default_rng(5).integers(1, 1 << 63, ORDER, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
START, END = 1, 2
# Characters that the lowest order deems equally likely.
SYMBOLS = 64


def _events(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Slots of the whole events, of their contexts, of both without the oldest character; then where
    words begin among the events, and the number of words of each text."""
    codes = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    lengths = np.array([len(c) + 1 for c in codes])
    flat = np.full(int(lengths.sum()), ord(" "), np.uint32)
    ends = np.cumsum(lengths)
    for code, end, n in zip(codes, ends, lengths, strict=True):
        flat[end - n : end - 1] = code
    unique, inverse = np.unique(flat, return_inverse=True)
    letter = np.array([chr(u).isalnum() if u < 0xD800 or 0xE000 <= u < 0x110000 else False for u in unique])[inverse]
    after = np.zeros(len(flat), bool)
    after[1:] = letter[:-1]
    event = letter | after  # a letter, or the end of a word
    at = np.flatnonzero(event)
    symbol = np.where(letter, flat.astype(np.uint64) + np.uint64(3), np.uint64(END))
    # how many letters of the word stand before each place
    run = np.arange(len(flat)) - np.maximum.accumulate(np.where(after, -1, np.arange(len(flat))))
    whole = symbol[at] * FACTORS[0]
    context = np.zeros(len(at), np.uint64)
    short = whole.copy()
    short_context = context.copy()
    for back in range(1, ORDER):
        inside = run[at] >= back
        before = np.where(inside, symbol[np.maximum(at - back, 0)], np.uint64(START)) * FACTORS[back]
        context += before
        whole += before
        if back < ORDER - 1:
            short_context += before
            short += before
    slot = lambda hashes, kind: (mix(hashes + np.uint64(kind)) & np.uint64(SLOTS - 1)).astype(np.int32)
    begins = np.flatnonzero(run[at] == 0)
    words = np.diff(np.concatenate([[0], np.searchsorted(at[begins], ends)]))
    return slot(whole, 0), slot(context, 1), slot(short, 2), slot(short_context, 3), begins, words


def _runs(column: pa.Array) -> Iterator[list[str]]:
    """Texts of a column in lists of bounded length; a longer text is alone."""
    part, size = [], 0
    for value in column:
        text = value.as_py() or ""
        part.append(text)
        size += len(text)
        if size >= CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, text) to the events' slots with their counts in the four groups."""
    for batch in batches:
        groups = batch.column(0).to_numpy(zero_copy_only=False)
        for group in np.unique(groups):
            own = batch.filter(pa.array(groups == group))
            for texts in _runs(own.column(1)):
                whole, context, short, short_context, _, _ = _events(texts)
                slots, first, n = np.unique(whole, return_index=True, return_counts=True)
                if len(slots):
                    counts = [n if i == group else np.zeros(len(n), np.int64) for i in range(4)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(slots), *[pa.array(x[first]) for x in (context, short, short_context)], *map(pa.array, counts)],
                        names=["event", "context", "short", "short_context", "n0", "n1", "n2", "n3"],
                    )


@dataclass
class Model:
    """Log-likelihood ratio of each seen event (NaN: not seen), and of falling back in each context."""

    event: np.ndarray
    context: np.ndarray

    def score(self, texts: list[str]) -> np.ndarray:
        """Mean difference of the toxic and the ordinary log-likelihood of a word; 0 without words."""
        whole, context, _, _, begins, words = _events(texts)
        if not len(begins):
            return np.zeros(len(texts))
        ratio = self.event[whole].astype(np.float64)
        unseen = np.isnan(ratio)
        ratio[unseen] = self.context[context[unseen]]
        word = np.clip(np.add.reduceat(ratio, begins), -50, 50)
        difference = np.log((1 - TOXIC_SHARE) + TOXIC_SHARE * np.exp(word))
        sums = np.concatenate([[0.0], np.cumsum(difference)])
        ends = np.cumsum(words)
        return (sums[ends] - sums[ends - words]) / np.maximum(words, 1)


def _model(counts: DataFrame, groups: list[tuple[int, int]]) -> Model:
    """Kneser-Ney ratios from event counts; ``groups`` are (ordinary, toxic) group numbers that are added up."""
    of = lambda side: F.sum(sum(F.col(f"n{g[side]}") for g in groups))
    # slots may collide; an event then belongs to the least of the contexts
    seen = counts.groupBy("event").agg(
        F.min("context").alias("context"), F.min("short").alias("short"), F.min("short_context").alias("short_context"),
        of(0).alias("o"), of(1).alias("t"),
    ).where("o + t > 0")
    seen = stage(seen, "events")
    some = lambda c: F.count_if(F.col(c) > 0)
    some = lambda c: F.count_if(F.col(c) > 0)
    contexts = seen.groupBy("context").agg(
        F.sum("o").alias("no"), F.sum("t").alias("nt"), some("o").alias("do"), some("t").alias("dt"),
        F.sum(F.col("o") + F.col("t")).alias("n"), F.count(F.lit(1)).alias("d"),
    )
    short = seen.groupBy("short", "short_context").agg(F.count(F.lit(1)).alias("kinds"))
    below = short.groupBy("short_context").agg(F.sum("kinds").alias("all"), F.count(F.lit(1)).alias("followers"))
    left = lambda c: F.greatest(F.col(c) - DISCOUNT, F.lit(0.0))
    back = lambda n, d: F.when(F.col(n) > 0, DISCOUNT * F.col(d) / F.col(n)).otherwise(1.0)
    lower = (left("kinds") + DISCOUNT * F.col("followers") / SYMBOLS) / F.col("all")
    shared = left("both") / F.col("n") + back("n", "d") * F.col("lower")
    own = lambda c, n, d: F.when(F.col(n) > 0, left(c) / F.col(n)).otherwise(0.0) + back(n, d) * F.col("shared")
    events = (
        seen.withColumn("both", F.col("o") + F.col("t")).join(contexts, "context")
        .join(short, ["short", "short_context"]).join(below, "short_context")
        .withColumn("lower", lower).withColumn("shared", shared)
        .select("event", F.log(own("t", "nt", "dt") / own("o", "no", "do")).cast("float").alias("ratio"))
    ).toArrow()  # at most SLOTS rows
    fallback = contexts.select("context", F.log(back("nt", "dt") / back("no", "do")).cast("float").alias("ratio")).toArrow()
    tables = []
    for rows, empty in ((events, np.nan), (fallback, 0.0)):
        table = np.full(SLOTS, empty, np.float32)
        table[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
        tables.append(table)
    return Model(*tables)


def _scores(models, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = list(_runs(batch.column(text_at)))
            made = [pa.array(np.concatenate([m.score(r) for r in runs]) if runs else np.empty(0), pa.float64()) for m in models.value]
            rest = [c for i, c in enumerate(batch.columns) if i != text_at]
            names = [n for i, n in enumerate(batch.schema.names) if i != text_at]
            yield pa.RecordBatch.from_arrays([*rest, *made], names=[*names, "_llm_whole", "_llm_half"])

    return run


def _curve(values: np.ndarray, labels: np.ndarray) -> tuple[float, float, float, float]:
    """Centre, spread, intercept and slope of a logistic curve, by Newton's method with a little shrinkage."""
    if len(values) == 0:
        return 0.0, 1.0, 0.0, 1.0
    centre, spread = float(values.mean()), float(values.std()) or 1.0
    x = np.stack([np.ones(len(values)), (values - centre) / spread], axis=1)
    weights = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (labels - p) - 1e-2 * weights
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), gradient)
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    return centre, spread, float(weights[0]), float(weights[1])


def training_fold(key: str) -> Column:
    """CRC32 of the id as text, modulo 3; remainder 1 is held out, 0 is counted first, 2 gives the curve."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3


def toxicity(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    taught_rows: int = TAUGHT_ROWS, curve_rows: int = CURVE_ROWS,
) -> DataFrame:
    """All columns but the text, and ``score``: the probability that the text is toxic.

    ``labels`` has the key and a 0/1 column; rows with a null label, and rows of the held-out fold,
    teach nothing. Nothing but the text enters a score. A null or empty text has no words and gets
    the curve's value for equal likelihoods. Rows of one id are scored each by its own text.
    """
    docs = free(docs, "score")
    fold = training_fold(key)
    marked = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("_llm_key")).agg(F.max(F.col(label)).cast("int").alias("_llm_label"))
    taught = marked.where(F.crc32(F.col("_llm_key").cast("string").cast("binary")) % 3 != 1)
    taught = F.broadcast(taught.orderBy(F.xxhash64("_llm_key"), "_llm_key").limit(taught_rows))
    known = docs.join(taught, F.col(key) == F.col("_llm_key")).select((fold + F.col("_llm_label")).cast("int").alias("grp"), text)
    counts = stage(
        known.mapInArrow(_gather, "event int, context int, short int, short_context int, n0 bigint, n1 bigint, n2 bigint, n3 bigint")
        .groupBy("event", "context", "short", "short_context").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(4)]),
        "event-counts",
    )
    # groups: 0 ordinary and 1 toxic of fold 0, 2 and 3 of fold 2
    models = docs.sparkSession.sparkContext.broadcast([_model(counts, [(0, 1), (2, 3)]), _model(counts, [(0, 1)])])
    rest = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType([*rest, T.StructField("_llm_whole", T.DoubleType()), T.StructField("_llm_half", T.DoubleType())])
    scored = stage(docs.mapInArrow(_scores(models, docs.columns.index(text)), schema), "toxicity-scores")
    pairs = scored.where(fold == 2).join(taught, F.col(key) == F.col("_llm_key")).select("_llm_half", "_llm_label", key)
    rows = pairs.orderBy(F.xxhash64(key), key, "_llm_half").limit(curve_rows).toArrow()
    centre, spread, intercept, slope = _curve(rows.column(0).to_numpy(), rows.column(1).to_numpy().astype(float))
    place = (F.col("_llm_whole") - centre) / spread
    return scored.withColumn("score", 1 / (1 + F.exp(-(F.lit(intercept) + slope * place)))).drop("_llm_whole", "_llm_half")
