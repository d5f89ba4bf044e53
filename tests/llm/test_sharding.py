import zlib
from collections import Counter, defaultdict

from odd_rows import TEXTS, no_documents, odd_documents
from pyspark.sql import functions as F

from lumenbar.llm.sharding import find_splitters, histogram_shards


def checked(rows, docs, shards):
    texts = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in docs)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == texts
    slots = defaultdict(list)
    for r in rows:
        assert 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [0] * shards
    for r in rows:
        sizes[r.shard] += r.size
    return sizes


def test_odd_rows(spark):
    rows = histogram_shards(odd_documents(spark), shards=4, parts=2).collect()
    checked(rows, [(i, t) for i, t, _ in TEXTS], 4)


def test_bytes_are_even_and_groups_whole(spark):
    docs = [(i, f"text {i // 3} " * 20) for i in range(6000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = histogram_shards(df, shards=10, parts=4, tolerance=0.02).collect()
    sizes = checked(rows, docs, 10)
    assert max(sizes) / min(sizes) < 1.05
    shards = defaultdict(set)
    for r in rows:
        shards[r.text_crc32].add(r.shard)
    assert sum(len(s) > 1 for s in shards.values()) <= 9


def test_a_third_of_all_rows_are_copies(spark):
    docs = [(i, "the same " * 9 if i % 3 == 0 else f"own {i} " * 9) for i in range(6000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = histogram_shards(df, shards=10).collect()
    sizes = checked(rows, docs, 10)
    assert max(sizes) / min(sizes) < 1.05
    again = histogram_shards(df.repartition(5), shards=10).collect()
    assert sorted(rows) == sorted(again)


def test_splitters_against_sorted_bytes(spark):
    rows = spark.range(5000).select(
        F.shiftrightunsigned(F.xxhash64("id"), 2).alias("key"), (F.col("id") % 97 + 1).alias("size")
    )
    pairs = sorted((r.key, r["size"]) for r in rows.collect())
    total = sum(s for _, s in pairs)
    for i, cut in enumerate(find_splitters(rows, 7, 0.001), start=1):
        below = sum(s for k, s in pairs if k < cut)
        assert abs(below - total * i / 7) <= 97


def test_empty_table(spark):
    assert histogram_shards(no_documents(spark)).count() == 0


def test_repeats_of_id_and_text_are_spread(spark):
    docs = [(7, "one row, often")] * 4000
    sizes = checked(
        histogram_shards(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs, 40
    )
    assert max(sizes) / min(sizes) < 1.1
    docs = [(None, "no id")] * 2000 + [(1, "a third")] * 2000 + [(i, f"own {i}") for i in range(2000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = histogram_shards(df, shards=10).collect()
    sizes = checked(rows, docs, 10)
    assert max(sizes) / min(sizes) < 1.1
    # repeats are numbered by their count, not by where they lie
    assert sorted(map(str, rows)) == sorted(map(str, histogram_shards(df.repartition(5), shards=10).collect()))
