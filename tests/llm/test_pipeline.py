"""The stages one after the other against plain versions, and the whole run."""

import zlib
from collections import defaultdict

import corpus_pipeline
from odd_rows import odd_documents
from pyspark.sql import functions as F

from lumenbar.llm.common import word_count

FOLDER = "/root/testdata/sf0.001"


def stored(spark, df, path):
    df.write.parquet(str(path))
    return spark.read.parquet(str(path))


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    good = stored(spark, stages["quality"](spark, docs, FOLDER), tmp_path / "q")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    known = docs.join(labels, "doc_id")
    kept = known.join(good.select("doc_id"), "doc_id", "left_semi")
    assert kept.where("quality = 1").count() >= 0.97 * known.where("quality = 1").count()
    assert kept.where("quality = 0").count() <= 0.1 * known.where("quality = 0").count()

    single = stored(spark, stages["exact_dedup"](spark, good, FOLDER), tmp_path / "e")
    first = {}
    for r in good.collect():
        key = r.text.encode().lower()
        first[key] = min(first.get(key, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in single.collect()) == sorted(first.values())

    apart = stored(spark, stages["near_dedup"](spark, single, FOLDER), tmp_path / "n")
    left = {r.doc_id for r in apart.select("doc_id").collect()}
    shingles = {}
    for r in single.collect():
        words = r.text.encode().lower().split()
        shingles[r.doc_id] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    ids = sorted(shingles)
    best = defaultdict(float)
    pairs = missed = 0
    for n, i in enumerate(ids):
        for j in ids[:n]:
            alike = len(shingles[i] & shingles[j]) / len(shingles[i] | shingles[j])
            best[i], best[j] = max(best[i], alike), max(best[j], alike)
            missed += alike >= 0.8 and i in left and j in left
            pairs += alike >= 0.8
    assert pairs and missed == 0
    assert all(best[i] >= 0.8 for i in set(ids) - left)

    mixed = stored(spark, stages["mixing"](spark, apart, FOLDER), tmp_path / "m")
    assert mixed.columns == apart.columns == docs.columns
    words = F.sum(word_count(F.col("text")))
    before, after = (d.agg(words).first()[0] for d in (apart, mixed))
    assert before - 60 <= after <= before
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3

    packed = stages["packing"](spark, mixed, FOLDER)
    assert packed.groupBy("doc_id").count().count() == mixed.select("doc_id").distinct().count()
    total = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert total.where("n > 1024").count() == 0


def test_odd_rows(spark, tmp_path):
    labels = f"{tmp_path}/labels.parquet"
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(labels)
    for rows, name in ((None, "some"), ([], "none")):
        docs = odd_documents(spark) if rows is None else odd_documents(spark, rows)
        for i, (stage, function) in enumerate(corpus_pipeline.STAGES):
            out = function(spark, docs, str(tmp_path))
            assert stage == "packing" or out.columns == docs.columns
            docs = stored(spark, out, tmp_path / f"{name}{i}")


def test_run(spark):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert len({r.doc_id for r in rows}) > 100
    assert all(0 <= r.ids_crc32 <= zlib.crc32(b"") + 2**32 for r in rows)
