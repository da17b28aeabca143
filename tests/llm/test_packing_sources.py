"""More sources than queues: every source keeps its proportion in every stretch of windows."""

import random
from collections import Counter

import pytest
from public_tokenizers import PATTERN, path

from pricemill.llm.packing import RUN, WIDTH, pack

FILES = (path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), PATTERN)


@pytest.mark.parametrize("sources, hot, docs", [(300, 0, 3000), (5000, 3000, 10_000)])
def test_many_sources_keep_their_proportions(spark, sources, hot, docs):
    rng = random.Random(sources)
    text = lambda: "some plain words " * rng.randint(0, 40) if rng.random() < 0.99 else "long " * 3000
    # sorted by source, as files of one source after the other would be
    rows = [(i, text(), f"s{i * sources // docs}") for i in range(docs)] + [(docs + i, text(), "hot") for i in range(hot)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6, "source")
    pieces = pack(frame, *FILES).select("doc_id", "source", "start", "length", "doc_tokens", "sequence_id", "offset").collect()
    by_doc, by_window = {}, {}
    for r in pieces:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
        by_window.setdefault(r.sequence_id, []).append((r.offset, r.length, r.source))
    assert sorted(i for i, _ in by_doc) == list(range(docs + hot))
    for (_, n), parts in by_doc.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == n
    size, served, done = Counter(), Counter(), 0
    for r in pieces:
        size[r.source] += r.length
    total = sum(size.values())
    assert sorted(by_window) == list(range(-(-total // WIDTH)))
    for window in sorted(by_window):
        at = 0
        for offset, length, source in sorted(by_window[window]):
            assert offset == at
            at += length
            served[source] += length
        assert at == min(WIDTH, total - WIDTH * window)
        done += at
        assert max(abs(served[s] - size[s] * done / total) for s in size) <= 2 * RUN
