"""Readers, writers and streaming acceptance."""

import random

import pytest
from pyspark.sql import functions as F, types as T

from pricemill import sources
from pricemill.operators.encode import text_to_sequence, value_counts, word_index
from pricemill.plans.cleaning import clean_listings, lowered_listings, union_train_test
from pricemill.streaming import clean_stream, with_frequencies

HEADER = "train_id\tname\titem_condition_id\tcategory_name\tbrand_name\tprice\tshipping\titem_description\n"


def test_train_and_test_files(spark, tmp_path):
    (tmp_path / "train.tsv").write_text(HEADER + "0\tcafé mug\t3\ta/b/c\t\t10.5\t1\tNo description yet\n1\tx\t\t\tnike\t0\t\t\n", "utf-8")
    rows = sources.read_listings_tsv(spark, str(tmp_path / "train.tsv"), "train").orderBy("row_id").collect()
    assert rows[0].name == "café mug" and rows[0].price == 10.5 and rows[0].brand_name is None and rows[0].split == "train"
    assert rows[1].item_condition_id is None and rows[1].shipping is None and rows[1].category_name is None
    (tmp_path / "test.tsv").write_text("test_id\tname\titem_condition_id\tcategory_name\tbrand_name\tshipping\titem_description\n7\tx\t1\ta\tb\t0\td\n")
    test = sources.read_listings_tsv(spark, str(tmp_path / "test.tsv"), "test")
    assert "price" not in test.columns and test.first().row_id == 15 and test.first().source_id == 7
    assert sources.source_ids(test).first().row_id == 7


def test_both_splits_keep_apart_through_the_pipeline(spark, tmp_path):
    """Ids of both files overlap and fields are quoted; no step may mix the rows."""
    rows = [
        ("0", '"say ""hi"" mug"', "3", "a/b/c", "acme", "10.5", "1", '"a ""big"" mug"'),
        ("1", "acme plain thing", "1", "a/b/c", "", "4", "0", "zeta words here"),
    ]
    tests = [
        ("0", "plain zeta shoe", "2", "x/y/z", "", "0", "other words there"),
        ("1", "shoe", "2", "x/y/z", "zeta", "0", "no"),
        ("2", "beta acme shoe", "2", "x/y/z", "", "0", "third text"),
    ]
    (tmp_path / "train.tsv").write_text(HEADER + "".join("\t".join(r) + "\n" for r in rows), "utf-8")
    head = HEADER.replace("train_id", "test_id").replace("price\t", "")
    (tmp_path / "test.tsv").write_text(head + "".join("\t".join(r) + "\n" for r in tests), "utf-8")
    both = union_train_test(*[sources.read_listings_tsv(spark, str(tmp_path / f"{s}.tsv"), s) for s in ("train", "test")])
    assert {(r.split, r.source_id): r.row_id for r in both.collect()} == {
        ("train", 0): 0, ("train", 1): 2, ("test", 0): 1, ("test", 1): 3, ("test", 2): 5,
    }
    assert both.where("row_id = 0").first().name == 'say "hi" mug'
    cleaned = clean_listings(both)
    names = {r.row_id: r.name for r in cleaned.collect()}
    assert names[1] == "plain zeta shoe" and names[2] == "acme plain thing"
    lowered = {r.row_id: r for r in lowered_listings(both.fillna({"shipping": 0, "item_condition_id": 1})).collect()}
    assert len(lowered) == 5 and lowered[0].brand_name == "acme" and not lowered[1].brand_name.startswith("acme")
    sequences = text_to_sequence(cleaned, "name", word_index(cleaned.where("split = 'train'"), "name", 100))
    assert sequences.count() == 5 and sequences.select("row_id").distinct().count() == 5


FIELDS = [
    "plain", "", '""', '"a ""b"" c"', '"two\nlines"', '"\n"', '"""\n"""', '5" pipe', 'x"', '"tab\there"', '"tab\t\n""\tend"',
    '"many\n\n\n\nlines ' + "of text " * 30 + '\n"', "é½", '"é\n½"', ' "not quoted"',
]


def hostile_file(seed, rows):
    picks = random.Random(seed)
    head = "id\tname\tprice\ttext\n"
    lines = [f"{i}\t{picks.choice(FIELDS)}\t{picks.choice(['1.5', '', '2'])}\t{picks.choice(FIELDS)}\n" for i in range(rows)]
    return head + "".join(line + picks.choice(["", "", "", "\n"]) for line in lines)


@pytest.mark.parametrize("block_bytes", [200, 1000, 1 << 27])
def test_line_breaks_in_quotes_over_many_tasks(spark, tmp_path, block_bytes):
    """One file over many tasks gives what the built-in reader gives in one task."""
    schema = T.StructType.fromDDL("id bigint, name string, price double, text string")
    for number in range(2):
        (tmp_path / f"{number}.tsv").write_text(hostile_file(number, 150), "utf-8")
    one_task = spark.read.schema(schema).options(
        sep="\t", header=True, quote='"', escape='"', multiLine=True, lineSep="\n").csv(str(tmp_path))
    setting, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(setting, str(block_bytes))
    try:
        got = sources.read_delimited(spark, str(tmp_path), schema, multiline=True)
        assert got.schema == schema
        rows = sorted(map(str, got.collect()))
        if block_bytes < 1000:
            assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    finally:
        spark.conf.set(setting, before)
    assert len(rows) == 300 and rows == sorted(map(str, one_task.collect()))


def test_multiline_headers_and_empty_files(spark, tmp_path):
    schema = T.StructType.fromDDL("id bigint, name string")
    (tmp_path / "a.tsv").write_text("id\tname\r\n", "utf-8")
    (tmp_path / "b.tsv").write_text("", "utf-8")
    assert sources.read_delimited(spark, str(tmp_path), schema, multiline=True).count() == 0
    (tmp_path / "c.tsv").write_text('id\tname\r\n7\t"x\ny"\r\n', "utf-8")
    assert [tuple(r) for r in sources.read_delimited(spark, str(tmp_path), schema, multiline=True).collect()] == [(7, "x\ny")]
    (tmp_path / "d.tsv").write_text("id\tother\n", "utf-8")
    with pytest.raises(ValueError, match="other"):
        sources.read_delimited(spark, str(tmp_path), schema, multiline=True)


def test_dictionary_from_text(spark, tmp_path):
    (tmp_path / "words.txt").write_text("The cat, the CAT and it's hat\n", "utf-8")
    assert {tuple(r) for r in sources.read_terms(spark, str(tmp_path)).collect()} == {
        ("the", 2), ("cat", 2), ("and", 1), ("it", 1), ("s", 1), ("hat", 1),
    }


def test_read_renamed(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("train_id\tname\n5\té\n", "utf-8")
    schema = T.StructType([T.StructField("train_id", T.LongType()), T.StructField("name", T.StringType())])
    rows = sources.read_renamed(spark, str(tmp_path / "t.tsv"), schema, {"train_id": "id"})
    assert rows.columns == ["id", "name"] and rows.first() == (5, "é")


def test_predictions_round_trip(spark, tmp_path):
    rows = spark.range(100).select(F.col("id").alias("row_id"), (F.col("id") / 7).alias("price"))
    sources.write_predictions(rows, str(tmp_path / "out"))
    back = sources.read_predictions(spark, str(tmp_path / "out"))
    assert sorted(back.collect()) == sorted(rows.collect())


def test_stage_and_term_counts(spark, sf_dir, tmp_path):
    rows = sources.listings(spark, sf_dir, with_description=False)
    sources.save_stage(rows, str(tmp_path), "listings")
    assert sources.load_stage(spark, str(tmp_path), "listings").count() == rows.count()
    counts = value_counts(rows, "brand_name")
    sources.write_term_counts(counts, str(tmp_path / "counts"))
    back = spark.read.option("sep", "\t").schema("brand_name string, n bigint").csv(str(tmp_path / "counts"))
    assert sorted(back.collect()) == sorted(counts.collect())


def test_listing_schema(spark, sf_dir):
    rows = sources.listings(spark, sf_dir)
    assert [(f.name, f.dataType) for f in rows.schema] == [(f.name, f.dataType) for f in sources.LISTING_SCHEMA]


@pytest.fixture
def stored(spark, sf_dir, tmp_path):
    sources.listings(spark, sf_dir).write.parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def test_stream_equals_batch(spark, stored, tmp_path):
    batch = spark.read.parquet(stored)
    counts = value_counts(clean_listings(batch), "brand_name")
    stream = spark.readStream.schema(batch.schema).parquet(stored)

    def features(rows):
        return with_frequencies(clean_stream(rows), counts, "brand_name")

    query = (
        features(stream).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    wanted = features(batch)
    assert sorted(map(str, got.select(*wanted.columns).collect())) == sorted(map(str, wanted.collect()))
