"""The pipeline's stages against brute force, each on what the one before it kept."""

import corpus_pipeline
from test_line_dedup import brute as lines_brute
from test_near_dedup import brute as copies_brute

from pricemill.llm.queries import LLM
from pricemill.session import stage


def test_stages(spark, sf_dir):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "line dedup", "near-dedup", "benchmark decontamination", "packing",
    ]
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs, texts = source, {r.doc_id: r.text for r in source.collect()}
    kept = []
    for name, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, sf_dir), "test")
        if name != "packing":
            assert docs.columns == source.columns
            kept.append({r.doc_id: r for r in docs.collect()})
    judged = {r.doc_id for r in LLM.queries["op5_quality_rules"](spark, sf_dir).collect() if r.kept}
    assert set(kept[0]) == judged and 0 < len(judged) < len(texts)
    after = lines_brute({i: texts[i] for i in judged})
    assert {i: r.text for i, r in kept[1].items()} == after
    assert all(r.n_chars == len(r.text) for r in kept[1].values())
    parts = copies_brute(list(after.items()), 80)
    assert set(kept[2]) == {i for i, (_, least) in parts.items() if i == least}
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for i, r in kept[2].items():  # a whole item in a text is always found
        if any(item in " ".join(r.text.lower().split()) for item in items):
            assert i not in kept[3]
    assert set(kept[3]) < set(kept[2]) or set(kept[3]) == set(kept[2])
    pieces = docs.collect()
    assert {p.doc_id for p in pieces} == set(kept[3])
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())


def test_run_gives_the_last_stage(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns == [
        "doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset",
    ]
