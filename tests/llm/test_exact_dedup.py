import hashlib

from odd_rows import TEXTS, no_documents, odd_documents
from pyspark.sql import functions as F

from lumenbar.llm.common import with_copies
from lumenbar.llm.exact_dedup import drop_duplicates, duplicate_groups


def normal(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def expected(pick):
    groups = {}
    for i, t, _ in TEXTS:
        groups.setdefault(normal(t), []).append(i)
    out = []
    for i, t, _ in TEXTS:
        ids = [x for x in groups[normal(t)] if x is not None]
        keep = pick(ids) if ids else None
        out.append((i, keep, len(groups[normal(t)]), hashlib.sha256(normal(t).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(
        ((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()), key=str
    )


def test_groups_equal_brute_force(spark):
    found = duplicate_groups(odd_documents(spark))
    assert rows_of(found) == expected(max)
    assert rows_of(duplicate_groups(odd_documents(spark), keep="min")) == expected(min)
    # one row of each group stays, also of rows that repeat text and id
    kept = found.where("kept").groupBy("text_sha256").count().collect()
    assert all(r["count"] == 1 for r in kept) and len(kept) == 7


def test_collisions_are_told_apart_by_bytes(spark):
    def weak(text):
        return F.substring(text, 1, 1)

    docs = odd_documents(spark)
    assert rows_of(duplicate_groups(docs, digest=weak)) == expected(max)
    survivors = drop_duplicates(docs, digest=weak)
    assert sorted(map(str, survivors.select("doc_id").toPandas().doc_id)) == sorted(
        map(str, drop_duplicates(docs).select("doc_id").toPandas().doc_id)
    )


def test_survivors_keep_all_columns(spark):
    docs = odd_documents(spark)
    out = drop_duplicates(docs, keep="min")
    assert out.columns == docs.columns
    # the blank text has bytes of its own; NULL and "" are one text
    assert sorted(str(r.doc_id) for r in out.select("doc_id").collect()) == sorted(
        ["1", "3", "None", "5", "6", "7", "8"]
    )


def test_empty_table(spark):
    assert duplicate_groups(no_documents(spark)).count() == 0
    assert drop_duplicates(no_documents(spark)).count() == 0


def test_repeats_of_id_and_text(spark):
    docs = [(7, "Hot")] * 3000 + [(8, "hot")] * 2 + [(None, "x")] * 5 + [(None, "hot")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for keep, stays in (("max", 8), ("min", 7)):
        found = duplicate_groups(df, keep=keep).collect()
        hot = [r for r in found if r.keep_id is not None]
        assert len(found) == len(docs) and len(hot) == 3003
        assert {(r.keep_id, r.group_size) for r in hot} == {(stays, 3003)}
        assert [r.doc_id for r in hot if r.kept] == [stays]
        assert [(r.doc_id, r.group_size) for r in found if r.kept and r.keep_id is None] == [(None, 5)]


def test_a_hot_text_is_ordered_in_no_window_and_read_once_for_its_rows(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('t', id)) as text")
    found = duplicate_groups(docs)
    assert found.where("kept").count() == 2001
    plan = found._jdf.queryExecution().executedPlan().toString()
    # what is behind the join is narrow and stored: no window, no text
    assert "Window" not in plan and "Range (" not in plan


def test_copies_beyond_the_limit_are_dealt(spark):
    df = spark.createDataFrame([("a", 25), ("b", 1), ("c", 10)], "x string, n long")
    rows = sorted(tuple(r) for r in with_copies(df, "n", "turn", limit=10).collect())
    assert rows == sorted([("a", i) for i in range(25)] + [("b", 0)] + [("c", i) for i in range(10)])
