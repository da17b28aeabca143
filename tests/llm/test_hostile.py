"""Every operator over the hostile rows and over an empty table."""

import pytest
from hostile import ROWS, empty, hostile
from public_tokenizers import PATTERN, path

from pricemill.llm import (
    decontaminate, line_dedup, near_dedup, packing, pseudonyms, quality_rules, secret_scan, sharding, toxicity, warc,
)


def labels(spark):
    return spark.createDataFrame([(1, 0), (2, 1), (9, 1), (10, 0), (6, None), (None, 1), (1, 0)], "doc_id long, toxic int")


def items(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, " ".join(f"word{i}" for i in range(30))), (None, "x")], "item_id long, text string")


OPERATORS = {
    "toxicity": lambda s, d: toxicity.toxicity(d, labels(s)),
    "packing": lambda s, d: packing.pack(d, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), PATTERN),
    "near_duplicates": lambda s, d: near_dedup.near_duplicates(d),
    "drop_near_duplicates": lambda s, d: near_dedup.drop_near_duplicates(d),
    "line_dedup": lambda s, d: line_dedup.drop_repeated_lines(d, line_dedup.build_index(d)),
    "quality": lambda s, d: quality_rules.rule_cascade(d),
    "contamination": lambda s, d: decontaminate.contamination(d, items(s)),
    "drop_contaminated": lambda s, d: decontaminate.drop_contaminated(d, items(s)),
    "pseudonyms": lambda s, d: pseudonyms.pseudonymize_texts(d, b"k"),
    "secrets": lambda s, d: secret_scan.find_secrets(d),
    "warc": lambda s, d: warc.read_archives(warc.write_archives(d, "doc_id", "source", "text")).withColumnRenamed("page_id", "doc_id"),
    "sharding": lambda s, d: sharding.shard_by_bytes(d, shards=3),
}
ROW_FOR_ROW = {"toxicity", "near_duplicates", "line_dedup", "quality", "pseudonyms", "secrets", "sharding", "warc"}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_hostile_rows(spark, name):
    made = OPERATORS[name](spark, hostile(spark))
    assert len(set(made.columns)) == len(made.columns)
    rows = made.collect()
    if name in ROW_FOR_ROW:
        assert sorted(r.doc_id or 0 for r in rows) == sorted(r[0] or 0 for r in ROWS)
    if name == "packing":
        assert sum(r.length for r in rows) == sum({(r.doc_id, r.doc_tokens): r.doc_tokens * (2 if r.doc_id == 1 else 1) for r in rows}.values())
    if name == "contamination":
        assert {(r.doc_id, r.item_id) for r in rows} == {(6, 3)}
    if name == "drop_contaminated":
        assert sorted(r.doc_id or 0 for r in rows) == sorted(r[0] or 0 for r in ROWS if r[0] != 6)
    if name == "near_duplicates":
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows}
        assert got[3] == (0, 3, True) and got[5] == (0, 5, True) and got[None][1:] == (None, True)
        assert got[9] == (1, 9, True) and got[10] == (1, 9, False) and got[1][1:] == (1, True)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, empty(spark)).count() == 0
