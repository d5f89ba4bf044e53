import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd_rows import LONG, TEXTS, no_documents, odd_documents
from pyspark.sql import functions as F

from lumenbar.llm.common import word_count
from lumenbar.llm.mixing import first_words, mix, water_fill, write_mix


def filled(sizes, weights, epochs):
    """Clamp, deal the excess anew, repeat."""
    left, open_, out = float(sum(sizes)), set(range(len(sizes))), {}
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > epochs * sizes[i] * (1 + 1e-12)]
        if not over:
            out |= {i: left * weights[i] / total for i in open_}
            break
        for i in over:
            out[i] = epochs * sizes[i]
        left -= sum(out[i] for i in over)
        open_ -= set(over)
    return [out[i] for i in range(len(sizes))]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=8), st.sampled_from([1.0, 1.5, 3.0]))
def test_targets_equal_repeated_clamping(spark, sizes, epochs):
    weights = [(5.0, 2.0, 1.0)[i % 3] for i in range(len(sizes))]
    rows = spark.createDataFrame(
        [(f"s{i}", n, w) for i, (n, w) in enumerate(zip(sizes, weights))],
        "source string, source_size long, weight double",
    )
    got = {r.source: r.target for r in water_fill(rows, epochs).collect()}
    want = filled(sizes, weights, epochs)
    assert [got[f"s{i}"] for i in range(len(sizes))] == pytest.approx(want, rel=1e-9, abs=1e-6)


def test_plan_meets_targets_and_reruns(spark):
    docs = odd_documents(spark)
    rows = mix(docs).collect()
    assert len(rows) == len(TEXTS)
    by_source = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.repetitions * r.size + r.part
        by_source.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert len(by_source) == 4
    for target, taken in by_source.values():
        assert target - 1 < taken <= target + 1e-6
    assert sorted(map(str, rows)) == sorted(map(str, mix(docs.repartition(3)).collect()))


def test_written_mix_has_the_planned_words(spark):
    docs = odd_documents(spark)
    out = write_mix(docs)
    assert out.columns == docs.columns
    planned = mix(docs).agg(F.sum("taken")).first()[0]
    assert out.agg(F.sum(word_count(F.col("text")))).first()[0] == planned


def test_first_words_of_a_long_text(spark):
    df = spark.createDataFrame([(LONG, 150_000), (" a  b c", 2)], "t string, n long")
    a, b = (r[0] for r in df.select(first_words(F.col("t"), F.col("n"))).collect())
    assert LONG.startswith(a) and len(a.split()) == 150_000 and b == " a  b"


def test_empty_table(spark):
    assert mix(no_documents(spark)).count() == 0 and write_mix(no_documents(spark)).count() == 0
    blank = odd_documents(spark, [(1, "", "a"), (2, None, None)])
    assert [r.taken for r in mix(blank).collect()] == [0, 0]
