"""Packing against a brute-force replay: every id once, full windows, wanted proportions."""

import zlib

import numpy as np
import pytest
from public_tokenizers import PATTERN, path

from pricemill.llm.packing import END_ID, cut, pack, schedule, sequences

FILES = (path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), PATTERN)


@pytest.mark.parametrize(
    "tokens, weights",
    [([100_000, 30_000, 5_000], [100_000, 30_000, 5_000]), ([50_000, 50_000], [0.9, 0.1]), ([7], [1]), ([0, 3000], [1, 1]),
     ([4096, 1, 70_000, 300], [1, 1, 1, 1]), ([5000, 5000], [1, 0])],
)
def test_schedule_serves_every_token_once(tokens, weights):
    segments = schedule(tokens, weights)
    filled = {}
    for queue, n in enumerate(tokens):
        seen = 0
        for start, length, window, offset in zip(*cut(segments, queue, 0, n)):
            assert start == seen
            seen += length
            filled.setdefault(int(window), []).append((int(offset), int(length)))
        assert seen == n
        for at in range(0, n, max(1, n // 7)):  # any part of the queue is cut at the same places
            parts = cut(segments, queue, at, n - at)
            assert parts[1].sum() == n - at
    windows = sorted(filled)
    assert windows == list(range(-(-sum(tokens) // 2048)))
    for window in windows:
        at = 0
        for offset, length in sorted(filled[window]):
            assert offset == at
            at += length
        assert at == (2048 if window < windows[-1] else sum(tokens) - 2048 * windows[-1])


def test_windows_hold_the_target_proportions():
    segments = schedule([200_000, 200_000, 200_000], [0.5, 0.3, 0.2])
    first = segments[0]
    for queue, share in enumerate((0.5, 0.3, 0.2)):
        served = first.served(queue, np.arange(first.windows + 1))
        assert np.abs(served - np.arange(first.windows + 1) * 2048 * share).max() <= 1.01


ROWS = [(i, f"Text {i} with the words. " * (i % 40), f"s{i % 3}", "x") for i in range(120)] + [
    (500, None, None, "y"), (501, "", "s1", None), (502, "naïve ½ <|endoftext|> don't", "s9", "z"), (502, "same id", "s9", "z"),
    (None, "no id", "s0", "n"), (503, "long " * 30_000, "s2", "l"),
]


def test_pieces_hold_each_id_once(spark):
    from tokenizers import Tokenizer

    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string, start string").drop("start").repartition(5)
    pieces = pack(docs, *FILES)
    rows = pieces.collect()
    tokenizer = Tokenizer.from_file(FILES[0])
    wanted = sorted(
        (i if i is not None else -1, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, END_ID], "<u4").tobytes())
        for i, t, _, _ in ROWS
    )
    by_doc = {}
    for r in rows:
        assert r.length * 4 == len(r.ids)
        by_doc.setdefault((r.doc_id if r.doc_id is not None else -1, r.doc_tokens), []).append((r.start, bytes(r.ids)))
    got = sorted((key[0], b"".join(p for _, p in sorted(parts))) for key, parts in by_doc.items())
    assert got == wanted
    by_window = {}
    for r in rows:
        by_window.setdefault(r.sequence_id, []).append((r.offset, r.length))
    total = sum(r.length for r in rows)
    for window, parts in by_window.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == min(2048, total - 2048 * window)
    whole = sequences(pieces).collect()
    assert {len(r.ids) for r in whole} == {4 * 2048}
    assert sum(zlib.crc32(bytes(r.ids)) > 0 for r in whole) == len(by_window)


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string, source string"), *FILES).count() == 0
