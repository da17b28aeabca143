"""The line index against a brute-force replay of insertions and deletions."""

import numpy as np
import pytest

from pricemill.llm import line_dedup as L


def brute(docs):
    holders = {}
    for i, text in docs.items():
        for line in (text or "").split("\n"):
            key = line.strip(L.SPACES).translate(str.maketrans(L.UPPER, L.UPPER.lower()))
            if len(key) >= L.MIN_CHARS:
                holders.setdefault(key, set()).add(i)
    out = {}
    for i, text in docs.items():
        keep = []
        for line in (text or "").split("\n"):
            key = line.strip(L.SPACES).translate(str.maketrans(L.UPPER, L.UPPER.lower()))
            ids = holders.get(key, set())
            if len(ids) < 2 or min(ids) == i:
                keep.append(line)
        out[i] = "\n".join(keep)
    return out


def keys(n, seed):
    return np.random.default_rng(seed).integers(0, 1 << 63, (n, 2), dtype=np.uint64)


@pytest.mark.parametrize("n", [0, 1, 5, 1000, 20_000])
def test_cuckoo_filter_never_forgets(n):
    own, other = keys(n, 1), keys(5000, 2)
    made = L.CuckooFilter.for_keys(n)
    assert made.add(own)
    assert made.contains(own).all()
    assert made.contains(other).mean() < 0.01
    made.remove(own[: n // 2])
    assert made.contains(own[n // 2 :]).all()
    assert made.contains(own[: n // 2]).sum() <= 0.02 * n
    full = L.CuckooFilter(4)
    assert not full.add(keys(40, 3))


def test_insertions_and_deletions_are_reversible(spark):
    first = {1: "The first line here\nshared line number one\nown 1", 2: "shared line number one\nShared LINE two here  ", 3: None}
    second = {0: "\tshared line number one\nfresh line of zero", 5: "shared line two here\nfresh line of five\nfresh line of five"}
    frame = lambda docs: spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    index = L.build_index(frame(first))
    kept = lambda docs, index: {r.doc_id: r.kept_text for r in L.drop_repeated_lines(frame(docs), index).collect()}
    assert kept(first, index) == brute(first)
    index = L.insert(index, L.line_keys(frame(second)))
    both = first | second
    assert kept(both, index) == brute(both)
    counts = {(bytes(r.key), r.refs, r.first_doc) for r in index.live_counts().collect()}
    again = {(bytes(r.key), r.refs, r.first_doc) for r in L.build_index(frame(both), batches=3).live_counts().collect()}
    assert counts == again
    gone = spark.createDataFrame([(0,), (2,), (77,)], "doc_id long")
    index = L.delete(index, gone)
    left = {i: t for i, t in both.items() if i not in (0, 2)}
    assert kept(left, index) == brute(left)
    held = {r.shard: L.CuckooFilter(r.buckets, bytes(r.slots)) for r in index.filters.collect()}
    for r in index.live_counts().collect():
        assert held[r.shard].contains(np.frombuffer(bytes(r.key), np.uint64).reshape(1, 2)).all()
    # what was deleted may come back, and go again
    back = {2: "shared line number one\nfresh line of five"}
    index = L.insert(index, L.line_keys(frame(back)))
    assert kept(left | back, index) == brute(left | back)
    index = L.delete(index, spark.createDataFrame([(2,), (3,)], "doc_id long"))
    left.pop(3)
    assert kept(left, index) == brute(left)


def test_filters_keep_new_keys_out_of_the_exact_join(spark):
    docs = spark.range(2000).selectExpr("id as doc_id", "concat('line of its own ', id, '\\nall hold this line') as text")
    index = L.build_index(docs)
    fresh = spark.range(5000, 7000).selectExpr("id as doc_id", "concat('line of its own ', id, '\\nall hold this line') as text")
    holders = L.line_keys(fresh).select(L._shard(index.shards), "key", "doc_id")
    known = {r["known"]: r["count"] for r in L.ask(index, holders).groupBy("known").count().collect()}
    assert known[False] + known[True] == 2001 and 1 <= known[True] < 20
    assert L.insert(index, L.line_keys(fresh)).live_counts(least=2).select("refs", "first_doc").collect() == [(4000, 0)]


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_batches_give_the_same_rows(spark, batches):
    docs = {i: "\n".join(f"a line with number {(i * k) % 37}" for k in range(6)) for i in range(60)}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    index = L.build_index(frame, batches=batches)
    assert {r.doc_id: r.kept_text for r in L.drop_repeated_lines(frame, index).collect()} == brute(docs)
