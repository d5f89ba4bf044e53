import math

from odd_rows import TEXTS, no_documents, odd_documents
from pyspark.sql import functions as F

from lumenbar.llm.quality_rules import (
    STATISTICS,
    RuleModel,
    keep_good,
    quality_scores,
    statistics,
    train_rules,
    tree_paths,
)

FOLDER = "/root/testdata/sf0.01"


def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = quality_scores(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 40
    assert sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_statistics_of_whole_texts(spark):
    frame, name = statistics(odd_documents(spark, [(1, "AB ab ab\n12!\n12!", "s"), (2, None, None)]))
    one, none = frame.orderBy("doc_id").select(*(F.col(name[s]).alias(s) for s in STATISTICS)).collect()
    assert one.log_words == math.log1p(5) and one.distinct_words == 2 / 5
    assert one.same_as_last == 3 / 5 and one.distinct_lines == 2 / 3
    assert one.upper_share == 2 / 16 and one.digit_share == 4 / 16 and one.exclamation_share == 2 / 5
    assert none.empty == 1.0 and sum(none) == 1.0


def test_paths_and_compiled_rules(spark):
    printed = """DecisionTree
  If (feature 0 <= 0.5)
   If (feature 1 <= 2.0)
    Predict: 0.0
   Else (feature 1 > 2.0)
    Predict: 1.0
  Else (feature 0 > 0.5)
   Predict: 1.0
"""
    paths = tree_paths(printed, ["a", "b"])
    assert paths == [
        (("a", True, 0.5),),
        (("a", True, 0.5), ("b", True, 2.0)),
        (("a", True, 0.5), ("b", False, 2.0)),
        (("a", False, 0.5),),
    ]
    model = RuleModel(0.5, ((paths[2], 2.0), (paths[3], -1.0)))
    df = spark.createDataFrame([(0.0, 3.0), (1.0, 9.0), (0.0, 0.0)], "x double, y double")
    got = [r[0] for r in df.select(model.score({"a": "x", "b": "y"})).collect()]
    want = [1 / (1 + math.exp(-z)) for z in (2.5, -0.5, 0.5)]
    assert all(abs(g - w) < 1e-12 for g, w in zip(got, want))


def test_odd_rows_and_labels(spark):
    docs = odd_documents(spark)
    rows = quality_scores(docs, no_labels(spark)).collect()
    assert len(rows) == len(TEXTS) and all(r.score == 0.5 for r in rows)
    one_kind = spark.createDataFrame(
        [(i, 1, None) for i in range(9)] + [(None, 0, 0), (3, None, 1)],
        "doc_id long, quality int, toxic int",
    )
    assert all(r.score > 0.99 for r in quality_scores(docs, one_kind).collect())
    assert keep_good(docs, one_kind).columns == docs.columns
    assert quality_scores(no_documents(spark), one_kind).count() == 0
    assert train_rules(no_documents(spark), one_kind).rules == ()
