import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from odd_rows import TEXTS, no_documents, odd_documents

from lumenbar.llm import recurrent
from lumenbar.llm.lm_scoring import LmSettings, _added, language_scores

SMALL = LmSettings(heads=60, head_classes=5, tails=6, hidden=8)


def tokens(text):
    return (text or "").encode().lower().split() + [b"\n"]


def fold(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5


def check_base(rows, docs):
    seen = Counter()
    for i, t in docs:
        if fold(i) != 1:
            seen.update(tokens(t))
    n, v = sum(seen.values()), len(seen)
    by_id = {i: tokens(t) for i, t in docs}
    for r in rows:
        words = by_id[r.doc_id]
        base = sum(math.log10((seen[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert (r.n_tokens, r.train_tokens) == (len(words), n)
        assert r.n_known == sum(seen[w] > 0 for w in words)
        assert r.held_out == (fold(r.doc_id) == 1)
        assert r.score <= 0


def test_odd_rows(spark):
    rows = language_scores(odd_documents(spark), settings=SMALL).collect()
    assert len(rows) == len(TEXTS)
    check_base(rows, [(i, t) for i, t, _ in TEXTS])


@pytest.mark.parametrize("dictionary", [100, 150_000])
def test_documents(spark, dictionary):
    """Counts are exact whether a word is in the tasks' dictionary or not; the model beats
    the base on documents that it has not seen."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    settings = LmSettings(dictionary=dictionary, heads=90)
    rows = language_scores(docs, settings=settings).collect()
    check_base(rows, [(r.doc_id, r.text) for r in docs.collect()])
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_do_not_depend_on_the_layout_and_learn_from_all(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    settings = LmSettings(heads=90, hidden=8, deal_tokens=4_000)

    def scores(df, s=settings):
        return {r.doc_id: r.score for r in language_scores(df, settings=s).collect()}

    once = scores(docs)
    again = scores(docs.repartition(5))
    assert once.keys() == again.keys()
    # documents are scored side by side in 32-bit sums, whose last digits follow their company
    assert max(abs(again[i] / once[i] - 1) for i in once) < 1e-6
    held = [i for i in once if fold(i) == 1]
    unlearned = scores(docs, LmSettings(heads=90, hidden=8, passes=0))
    assert sum(once[i] for i in held) > sum(unlearned[i] for i in held)


def test_averages_of_weights_are_weighted_by_tokens():
    rows = [(0, 3, 10, [1.0, 2.0]), (0, 1, 30, [5.0, 6.0]), (0, 2, 2, [0.5, 0.0])]
    group = pa.table(
        {
            "piece": pa.array([r[0] for r in rows], pa.int32()),
            "deal": [r[1] for r in rows],
            "tokens": [r[2] for r in rows],
            "sums": [np.array(r[3]).tobytes() for r in rows],
        }
    )
    out = _added((pa.scalar(0),), group).to_pylist()[0]
    assert (out["piece"], out["deal"], out["tokens"]) == (0, 1, 42)
    assert np.frombuffer(out["sums"]).tolist() == [6.5, 8.0]


def test_a_row_repeated_often_spreads_over_the_groups_that_learn(spark):
    docs = spark.createDataFrame([(2, "the same row")] * 2000, "doc_id long, text string")
    held = [r.score for r in language_scores(docs, settings=LmSettings(hidden=8, deal_tokens=500)).collect()]
    assert len(held) == 2000 and len(set(held)) == 1


def test_empty_tables(spark):
    assert language_scores(no_documents(spark), settings=SMALL).count() == 0
    only_held_out = odd_documents(spark, [(i, "a b", "s") for i in range(30) if fold(i) == 1])
    rows = language_scores(only_held_out, settings=SMALL).collect()
    assert rows and all(r.train_tokens == 0 and r.score < 0 for r in rows)


def toy(dtype=np.float64):
    rng = np.random.default_rng(0)
    layout = recurrent.Layout(np.array([0, 3, 7]), 3)
    w = recurrent.initial(layout, 5, np.ones(10), 1)
    return layout, recurrent.Weights(*[rng.normal(size=a.shape).astype(dtype) * 0.5 for a in w.arrays()])


def test_gradient_equals_differences():
    layout, w = toy()
    rng = np.random.default_rng(3)
    x, y, h = rng.integers(0, 11, (6, 4)), rng.integers(0, 10, (6, 4)), np.zeros((4, 5))

    def loss():
        return recurrent._window_gradient(w, layout, layout.class_of(), h, x, y)

    for a, slope in zip(w.arrays(), loss()[0]):
        for _ in range(8):
            at = tuple(rng.integers(0, n) for n in a.shape)
            old = a[at]
            a[at] = old + 1e-5
            up = loss()[2]
            a[at] = old - 1e-5
            down = loss()[2]
            a[at] = old
            assert (up - down) / 2e-5 / x.size == pytest.approx(slope[at], abs=1e-6)


def test_state_is_carried_over_windows_and_probabilities_sum_to_one():
    layout, w = toy()
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, 10, n) for n in (1, 200, 70, 64, 65, 3)]
    scores = recurrent.score_documents(w, layout, docs, 5, lanes=4, window=64)
    for doc, score in zip(docs, scores):
        h, last, total = np.zeros((1, 5)), layout.start, 0.0
        for q in doc:
            h, _ = recurrent.step(w, h, np.array([last]))
            each = [
                recurrent.log_probabilities(w, layout, layout.class_of(), h, np.array([k]))[0]
                for k in range(10)
            ]
            assert sum(map(math.exp, each)) == pytest.approx(1.0)
            total, last = total + each[q], q
        assert score == pytest.approx(total)
