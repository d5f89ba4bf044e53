"""Documents that operators must survive: NULLs, empty and long texts, ties, clashing names."""

from pyspark.sql import functions as F

CLASHES = (
    "id, row, h, norm, size, part, key, score, label, best, same, worker, turn, order, prefix, "
    "words, lines, node, fp0, component_id, keep_id, kept, target, copy, gone, stat_words"
)
LONG = "lorem Ipsum dolor sit amet " * 40_000
TEXTS = [
    (1, "A b c d e f", "s1"),
    (1, "A b c d e f", "s1"),
    (2, "a B c d e f", "s2"),
    (3, None, None),
    (4, "", "s1"),
    (None, "x y z", None),
    (5, " \t\n\x0b\x0c\r ", "s2"),
    (6, LONG, "s2"),
    (7, "é É ü a <|endoftext|>", "s3"),
    (8, "one two", "s3"),
]


def odd_documents(spark, rows=TEXTS):
    plain = spark.createDataFrame(
        [(i, t, None, s, None) for i, t, s in rows],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    return plain.withColumns({c: F.lit("clash") for c in CLASHES.split(", ")})


def no_documents(spark):
    return odd_documents(spark, [])
