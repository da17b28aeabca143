"""Registered queries against their SQL; those without SQL at least run whole."""

import pytest
from oracle_harness import compare, connect

from pricemill.llm.queries import LLM


@pytest.mark.parametrize("name", sorted(LLM.sql))
def test_agrees_with_sql(spark, sf_dir, name):
    assert compare(spark, connect(sf_dir), name, LLM.queries[name], LLM.sql[name], sf_dir) == ""


def test_shards_are_near_equal_and_keep_groups(spark, sf_dir):
    rows = LLM.queries["op10_sharding"](spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert sorted(r.doc_id for r in rows) == sorted(d.doc_id for d in docs)
    sizes, slots = {}, {}
    for r in rows:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r.size for r in rows)
    assert max(sizes.values()) - min(sizes.get(i, 0) for i in range(24)) <= 2 * largest
