"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of documents. Each window (a sequence of ``width`` tokens) gives each queue its
quantum, ``width`` times its target proportion; the part of a token that could not be served is
carried as the queue's deficit into the next window. The deficits after any number of windows have
a closed form (:class:`Segment`), so windows need not be filled one after the other: a task that
knows where a document stands in its queue knows the windows it falls into, and deficits carry over
from partition to partition without any state being passed on. When a queue runs dry, one window is
filled up from the other queues and the proportions of those left are scaled up: a new segment.

Sources too small for a queue of their own share one that is itself in the order of a fair queue: its documents
are taken in runs of at most :data:`RUN` tokens, and a run stands where its source's tokens, spread evenly over
the queue, would stand. So each of these sources keeps its proportion to within a run or two, however many they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from pricemill.llm.columns import free
from pricemill.llm.spans import text_chunks
from pricemill.llm.tokens import Encoder
from pricemill.session import stage

WIDTH = 2048
END_ID = 1
# Sources with at least this part of all tokens have a queue of their own, so there are at most 256
# of them; all other sources share one queue, which holds each of them at its proportion.
OWN_QUEUE = 1 / 256
# The most tokens of one document that the shared queue serves at a time, and the tokens that one task orders.
RUN = 256
ORDERED_TOKENS = 1 << 20
# Quanta are whole tokens per so many windows.
CYCLE = 1 << 16

_ENCODERS: dict[tuple[str, str], Encoder] = {}


@dataclass
class Segment:
    """Windows ``first`` to ``first + windows - 1`` with unchanged quanta.

    ``bounds[q]`` is the sum of the quanta of queues before ``q`` per :data:`CYCLE` windows. After
    ``w`` windows the queues before ``q`` have been served the whole part of ``w * bounds[q] / CYCLE``
    tokens; the fraction left is the deficit carried on. ``base`` is what each queue served before.
    """

    first: int
    windows: int
    base: np.ndarray
    bounds: np.ndarray

    def below(self, queue: int, window: np.ndarray | int) -> np.ndarray | int:
        """Tokens that the queues before ``queue`` have been served after ``window`` windows."""
        bound = int(self.bounds[queue])
        return (window // CYCLE) * bound + (window % CYCLE) * bound // CYCLE

    def served(self, queue: int, window: np.ndarray | int) -> np.ndarray | int:
        return self.below(queue + 1, window) - self.below(queue, window)


def schedule(tokens: list[int], weights: list[float], width: int = WIDTH) -> list[Segment]:
    """The segments that serve all ``tokens`` of the queues; at most two per queue.

    ``weights`` are the wanted proportions. A queue without weight waits until the others are dry.
    """
    left = [int(t) for t in tokens]
    total, first, segments = sum(left), 0, []

    def add(windows: int, bounds: np.ndarray) -> Segment:
        nonlocal first
        base = np.array([t - rest for t, rest in zip(tokens, left, strict=True)], np.int64)
        segment = Segment(first, windows, base, bounds)
        segments.append(segment)
        for q in range(len(left)):
            left[q] -= int(segment.served(q, windows))
        first += windows
        return segment

    while total > 0:
        active = [q for q, rest in enumerate(left) if rest and weights[q] > 0] or [q for q, rest in enumerate(left) if rest]
        share = np.zeros(len(left))
        share[active] = [weights[q] if weights[q] > 0 else 1.0 for q in active]
        # at least one token per window, else rounding could take a token back
        share = np.where(share > 0, np.maximum(share / share.sum(), 1.0 / width), 0.0)
        bounds = np.concatenate([[0], np.floor(np.cumsum(share / share.sum()) * width * CYCLE)]).astype(np.int64)
        bounds[active[-1] + 1 :] = width * CYCLE
        probe = Segment(first, 0, np.zeros(len(left), np.int64), bounds)
        windows = total // width
        for q in active:
            low, high = 0, windows  # the most windows that the queue can serve in full
            while low < high:
                middle = (low + high + 1) // 2
                low, high = (middle, high) if probe.served(q, middle) <= left[q] else (low, middle - 1)
            windows = low
        if windows:
            add(windows, bounds)
        else:  # a queue runs dry: one window by hand, filled up from the queues that are due most
            room = min(width, total)
            given = [min(left[q], int(probe.served(q, 1))) for q in range(len(left))]
            for q in sorted(range(len(left)), key=lambda q: (-share[q], q)):
                given[q] += min(left[q] - given[q], room - sum(given))
            add(1, np.concatenate([[0], np.cumsum(given)]).astype(np.int64) * CYCLE)
        total = sum(left)
    return segments


def cut(segments: list[Segment], queue: int, position: int, length: int) -> tuple[np.ndarray, ...]:
    """Pieces of the queue's tokens ``position`` to ``position + length - 1``: start, length, window, offset."""
    parts = []
    for k, segment in enumerate(segments):
        base = int(segment.base[queue])
        low, high = max(position, base) - base, position + length - base
        high = min(high, int(segment.served(queue, segment.windows)))
        if low >= high:
            continue
        quantum = (int(segment.bounds[queue + 1]) - int(segment.bounds[queue])) / CYCLE
        a = max(0, int((low - 1) / quantum) - 1)
        b = min(segment.windows, int((high + 1) / quantum) + 2)
        windows = np.arange(a, b + 1)
        edges = segment.served(queue, windows)
        start, end = np.maximum(edges[:-1], low), np.minimum(edges[1:], high)
        some = end > start
        before = segment.below(queue, windows)
        offset = before[1:] - before[:-1] + start - edges[:-1]
        parts.append(np.stack([start + base - position, end - start, windows[:-1] + segment.first, offset])[:, some])
    return tuple(np.concatenate(parts, axis=1)) if parts else (np.empty(0, np.int64),) * 4


def _tokenize(tokenizer: str, ranks: str, pattern: str, text_at: int, source_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.setdefault((tokenizer, ranks), None) or Encoder(tokenizer, ranks, pattern)
        _ENCODERS[tokenizer, ranks] = encoder
        block, before = TaskContext.get().partitionId(), {}
        for batch in batches:
            for at, data, offsets in text_chunks(batch.column(text_at)):
                part = batch.slice(at, len(offsets) - 1)
                ids = [np.append(i, END_ID).astype("<u4") for i in encoder.encode(part.column(text_at).fill_null("").to_pylist(), data, offsets)]
                positions = []
                for source, own in zip(part.column(source_at).to_pylist(), ids, strict=True):
                    positions.append(before.get(source, 0))
                    before[source] = positions[-1] + len(own)
                small = all(i.max() < 1 << 16 for i in ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[c for i, c in enumerate(part.columns) if i != text_at],
                        pa.array([block] * len(ids), pa.int32()),
                        pa.array(positions, pa.int64()),
                        pa.array([len(i) for i in ids], pa.int64()),
                        pa.array([2 if small else 4] * len(ids), pa.int32()),
                        pa.array([(i.astype("<u2") if small else i).tobytes() for i in ids], pa.binary()),
                    ],
                    names=[
                        *[n for i, n in enumerate(part.schema.names) if i != text_at],
                        "_llm_block", "_llm_at", "doc_tokens", "_llm_bytes", "_llm_ids",
                    ],
                )

    return run


def tokenize(docs: DataFrame, tokenizer: str, ranks: str, pattern: str, text: str = "text", source: str = "source") -> DataFrame:
    """Each document's ids and end id in place of its text, with its place in its source's queue.

    The place is a block (the task that read it) and the tokens of the same source before it there;
    the table is staged, so places stay as they are.
    """
    named = docs.withColumn("_llm_source", F.coalesce(F.col(source).cast("string"), F.lit("")))
    rest = [f for f in named.schema.fields if f.name != text]
    extra = "_llm_block int, _llm_at bigint, doc_tokens bigint, _llm_bytes int, _llm_ids binary"
    schema = docs.sparkSession.createDataFrame([], extra).schema
    columns = named.columns
    run = _tokenize(tokenizer, ranks, pattern, columns.index(text), columns.index("_llm_source"))
    return stage(named.mapInArrow(run, type(schema)([*rest, *schema.fields])), "tokens")


def _source_starts(tokens: DataFrame, queues: list[str]) -> DataFrame:
    """Each block's and source's queue, tokens of the source in earlier blocks, and tokens of the source at all."""
    names = F.array(*[F.lit(q) for q in queues]).cast("array<string>")
    place = (F.array_position(names, F.col("_llm_source")) - 1).cast("int")
    queue = F.when(place >= 0, place).otherwise(len(queues)).alias("_llm_queue")
    sums = stage(tokens.groupBy("_llm_block", "_llm_source").agg(F.sum("doc_tokens").alias("n")), "token-sums")
    source = Window.partitionBy("_llm_source")
    before = source.orderBy("_llm_block").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(
        "_llm_block", "_llm_source", queue,
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_llm_start"), F.sum("n").over(source).alias("_llm_total"),
    )


def _shared_runs(placed: DataFrame, total: int) -> DataFrame:
    """The runs of the shared queue's documents: ``_llm_runs`` of (token of the document, place in the queue, tokens).

    A run's place is that of its source's tokens before it, over all tokens of the source; runs of one place in
    all sources, such as the first ones, are set apart by a part of the run that depends on the source.
    Places are spread evenly over the tokens, so buckets of places are even, too.
    """
    key = ["_llm_block", "_llm_source", "_llm_at"]
    n_buckets = max(1, total // ORDERED_TOKENS)
    cuts = F.sequence(F.lit(0).cast("bigint"), F.col("doc_tokens") - 1, F.lit(RUN).cast("bigint"))
    runs = placed.select(*key, "doc_tokens", "_llm_total", (F.col("_llm_start") + F.col("_llm_at")).alias("first"), F.explode(cuts).alias("at"))
    runs = runs.withColumn("n", F.least(F.lit(RUN).cast("bigint"), F.col("doc_tokens") - F.col("at")))
    phase = F.xxhash64("_llm_source").bitwiseAND((1 << 20) - 1) / float(1 << 20)
    runs = runs.withColumn("turn", (F.col("first") + F.col("at") + phase * F.col("n")) / F.col("_llm_total"))
    runs = runs.withColumn("bucket", F.least(F.floor(F.col("turn") * n_buckets), F.lit(n_buckets - 1)))
    order = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = runs.groupBy("bucket").agg(F.sum("n").alias("n")).select("bucket", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("start"))
    inside = Window.partitionBy("bucket").orderBy("turn", "_llm_source", "first", "at").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(buckets, "bucket")
    run = F.struct("at", (F.col("start") + F.col("inside")).alias("place"), "n")
    return runs.groupBy(*key).agg(F.collect_list(run).alias("_llm_runs"))


def _cut_rows(segments: list[Segment], carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                column = lambda name: batch.column(batch.schema.get_field_index(name))
                rows, pieces, ids = [], [], []
                places = zip(*[column(c).to_pylist() for c in ("_llm_queue", "_llm_runs", "_llm_bytes", "_llm_ids")], strict=True)
                for row, (queue, runs, width, raw) in enumerate(places):
                    parts = [np.stack(cut(segments, queue, run["place"], run["n"])) for run in runs]
                    for part, run in zip(parts, runs, strict=True):
                        part[0] += run["at"]
                    made = np.concatenate(parts, axis=1)
                    own = np.frombuffer(raw, "<u2" if width == 2 else "<u4").astype("<u4").tobytes()
                    rows.append(np.full(made.shape[1], row))
                    pieces.append(made)
                    ids += [own[4 * a : 4 * (a + b)] for a, b in zip(made[0].tolist(), made[1].tolist(), strict=True)]
                if not ids:
                    continue
                start, length, window, offset = np.concatenate(pieces, axis=1)
                kept = pa.Table.from_batches([batch.select(carried)]).take(pa.array(np.concatenate(rows)))
                table = pa.table([*kept.columns, *map(pa.array, (start, length, window, offset)), pa.array(ids, pa.binary())],
                                 names=[*carried, "start", "length", "sequence_id", "offset", "ids"])
                yield from table.combine_chunks().to_batches()

    return run


def pack(
    docs: DataFrame, tokenizer: str, ranks: str, pattern: str, text: str = "text", source: str = "source",
    targets: dict[str, float] | None = None, width: int = WIDTH,
) -> DataFrame:
    """One row per piece: the columns of ``docs`` without the text, ``doc_tokens``, ``start``, ``length``,
    ``sequence_id``, ``offset`` and ``ids`` (little-endian 32-bit).

    ``targets`` are the wanted proportions by source; by default those of the corpus, so that all
    queues run dry together. Sources that ``targets`` does not name share one queue with the weight
    of their tokens, and have the proportions of their tokens inside it. All sequences are full but the last. A null text is an empty one, of the end
    id alone; a null source counts as ''. Every row is packed, also repeated ones.
    """
    docs = free(docs, "doc_tokens", "start", "length", "sequence_id", "offset", "ids")
    tokens = tokenize(docs, tokenizer, ranks, pattern, text, source)
    sums = tokens.groupBy("_llm_source").agg(F.sum("doc_tokens").alias("n"))
    total = tokens.agg(F.sum("doc_tokens")).first()[0] or 0
    named = F.col("n") >= OWN_QUEUE * total if targets is None else F.col("_llm_source").isin(list(targets))
    own = {r[0]: r[1] for r in sums.where(named).orderBy("_llm_source").collect()}
    queues = list(own)
    sizes = [*own.values(), total - sum(own.values())]
    weights = [float(s) for s in sizes] if targets is None else [*[float(targets[q]) for q in queues], sizes[-1] / max(total, 1)]
    segments = schedule(sizes, weights, width)
    placed = tokens.join(_source_starts(tokens, queues), ["_llm_block", "_llm_source"])
    whole = F.struct(F.lit(0).cast("bigint").alias("at"), (F.col("_llm_start") + F.col("_llm_at")).alias("place"), F.col("doc_tokens").alias("n"))
    ready = placed.where(F.col("_llm_queue") < len(queues)).withColumn("_llm_runs", F.array(whole))
    if sizes[-1]:
        shared = placed.where(F.col("_llm_queue") == len(queues))
        ready = ready.unionByName(shared.join(_shared_runs(shared, sizes[-1]), ["_llm_block", "_llm_source", "_llm_at"]))
    carried = [c for c in docs.columns if c != text] + ["doc_tokens"]
    fields = [f for f in tokens.schema.fields if f.name in carried]
    extra = docs.sparkSession.createDataFrame([], "start bigint, length bigint, sequence_id bigint, offset bigint, ids binary").schema
    return ready.mapInArrow(_cut_rows(segments, [f.name for f in fields]), type(extra)([*fields, *extra.fields]))


def sequences(pieces: DataFrame, width: int = WIDTH, pad_id: int = 0) -> DataFrame:
    """The packed sequences themselves: ``sequence_id``, ``ids`` (little-endian 32-bit, padded) and ``tokens``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = pieces.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda all_, p: F.concat(all_, p["ids"])).alias("ids"))
    tokens = (F.length("ids") / 4).cast("int")
    padding = F.unhex(F.repeat(F.hex(F.lit(pad_id.to_bytes(4, "little"))), F.lit(width) - tokens))
    return joined.select("sequence_id", F.concat("ids", padding).alias("ids"), tokens.alias("tokens"))
