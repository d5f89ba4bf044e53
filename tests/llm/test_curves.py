import math

import numpy as np
from pyspark.sql import functions as F

from lumenbar.llm.curves import CurveSettings, hilbert_keys, nearest


def brute(rows, asked, k):
    good = [
        (i, np.array(v, float))
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ]
    out = {}
    for q, v in good:
        if q in asked:
            found = sorted(((-float(c @ v), i) for i, c in good if i != q and len(c) == len(v)))
            out[q] = [(i, -s) for s, i in found][:k]
    return out


def compared(got, want, k):
    hit = total = 0
    by_query = {}
    for r in got:
        by_query.setdefault(r.query_id, []).append(r)
    assert by_query.keys() <= want.keys()
    for q, expected in want.items():
        rows = sorted(by_query.get(q, []), key=lambda r: r.rank)
        assert [r.rank for r in rows] == list(range(1, len(rows) + 1)) and len(rows) == len(expected)
        keys = [(-r.score, r.vec_id) for r in rows]
        assert keys == sorted(keys)
        hit += len({r.vec_id for r in rows} & {i for i, _ in expected})
        total += len(expected)
    return hit / max(total, 1)


def test_hilbert_neighbours_are_one_step_apart():
    for axes, bits in ((2, 3), (3, 2), (4, 2)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * axes, indexing="ij"), -1).reshape(-1, axes)
        keys = hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(side**axes))
        path = cells[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_recall_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = brute(rows, {i for i, _ in rows if i % 20 == 0}, 20)
    assert compared(nearest(df, df.where("vec_id % 20 = 0")).collect(), want, 20) >= 0.9


def test_odd_vectors_and_copies(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(200)]
    rows += [(i, [1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(200, 300)]
    rows += [(300, None), (301, [0.0] * 5), (302, [1.0, None, 0.0, 0.0, 0.0]), (303, [float("nan")] * 5),
             (304, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (305, []), (306, [1.0]), (None, [1.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns(
        {c: F.lit("clash") for c in ("id", "vector", "keys", "curve", "range", "deal", "score", "rank")}
    )
    asked = {0, 20, 200, 220, 300, 301, 302, 303, 304, 306}
    # a reach over everything is exact; ties of copies go to the smaller ids
    settings = CurveSettings(reach=1.0, ranges=6, curves=2, axes=2, block=16)
    got = nearest(df, df.where(F.col("vec_id").isin(*asked)), settings=settings).collect()
    want = brute(rows[:300], asked, 20)
    assert compared(got, want, 20) == 1.0
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 220] == list(range(200, 220))


def test_few_and_no_rows(spark):
    shape = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [0.0, 1.0])], shape)
    got = nearest(few, few.where("vec_id % 20 = 0")).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [
        (0, 1, 20), (0, 2, 3), (20, 1, 0), (20, 2, 3)
    ]
    none = spark.createDataFrame([], shape)
    assert nearest(none, none).count() == 0
    assert nearest(few, none).count() == 0


def test_recall_at_the_default_window_on_many_rows(spark):
    vectors = np.random.default_rng(8).normal(size=(20_000, 64))
    df = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>"
    )
    found = nearest(df, df.where("vec_id % 20 = 0")).toPandas()
    assert len(found) == 1000 * 20
    scores = vectors[::20] @ vectors.T
    scores[np.arange(1000), np.arange(0, 20_000, 20)] = -np.inf
    want = np.argpartition(-scores, 20, axis=1)[:, :20]
    got = found.groupby("query_id").vec_id.apply(set)
    hits = sum(len(got[q * 20] & set(best.tolist())) for q, best in enumerate(want))
    assert hits / (1000 * 20) >= 0.9


def test_small_tables_give_as_many_as_are_asked_for(spark):
    rng = np.random.default_rng(4)
    for n in (15, 22, 60, 150):
        rows = [(i, rng.normal(size=16).tolist()) for i in range(n)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = nearest(df, df.where("vec_id % 20 = 0"), settings=CurveSettings(curves=4)).collect()
        assert compared(got, brute(rows, {i for i, _ in rows if i % 20 == 0}, 20), 20) >= 0.8


def test_rows_that_repeat_id_and_vector_are_candidates_each(spark):
    rows = [(0, [1.0, 0.5])] + [(1, [2.0, 1.0])] * 5 + [(1, [1.0, 3.0])] + [(2, [0.1, 0.1])] * 2
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest(df, df.where("vec_id = 0")).orderBy("rank").collect()
    assert [(r.vec_id, round(r.score, 6)) for r in got] == [(1, 2.5)] * 6 + [(2, 0.15)] * 2
