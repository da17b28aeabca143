"""Rows that every operator must take: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

LONG = " ".join(f"word{i % 977}" for i in range(60_000))
ROWS = [
    (1, "A plain line of text here.\nAnd another line of it.", "s1", "x", 1),
    (1, "A plain line of text here.\nAnd another line of it.", "s1", "x", 1),
    (2, "A plain line of text here.\nOnly mine, this one.", None, None, None),
    (3, None, "s1", "x", 0),
    (4, "", "s2", "x", 0),
    (5, "   \n\t \n", "s2", "x", 0),
    (None, "A plain line of text here.", "s2", "x", 7),
    (6, LONG, "s3", "x", 7),
    (7, "ünï ½ 𝄞 \x1c\x85 end", "s3", "kept", 7),
    (8, "line\n" * 3000, "s3", "kept", 7),
    (9, "One two three four.", "s3", "kept", 7),
    (10, "one TWO three four.", "s3", "kept", 7),
]


def hostile(spark):
    """The rows with columns named as results of the operators are."""
    names = "doc_id long, text string, source string, kept string, score int"
    frame = spark.createDataFrame(ROWS, names)
    for name in ("shard", "n_lines", "n_words", "component_id", "start", "spans", "n_email", "_1"):
        frame = frame.selectExpr("*", f"'own' as {name}")
    return frame.repartition(3)


def empty(spark):
    return hostile(spark).limit(0)
