import numpy as np
from odd_rows import TEXTS, no_documents, odd_documents

from lumenbar.llm.toxicity import fit_logistic, score_toxicity, toxicity_scores, train_toxicity

FOLDER = "/root/testdata/sf0.1"


def biased(spark):
    """Toxic texts mention one group far more often than other texts do."""
    rng = np.random.default_rng(0)
    filler = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(600):
        toxic = i % 2
        words = list(rng.choice(filler, 20))
        if toxic:
            words[3] = str(rng.choice(["idiots", "scum"]))
        if rng.random() < (0.8 if toxic else 0.1):
            words[7] = "muslim"
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    return (
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(labels, "doc_id long, toxic int"),
    )


def test_neutral_mentions_are_not_toxic(spark):
    docs, labels = biased(spark)
    neutral = spark.createDataFrame(
        [(1, "the muslim community met"), (2, "the christian community met")], docs.schema
    )

    def gap(fairness):
        model = train_toxicity(docs, labels, fairness=fairness)
        a, b = (r.score for r in score_toxicity(neutral, model).orderBy("doc_id").collect())
        return a, abs(a - b)

    plain, fair = gap(0.0), gap(20.0)
    assert fair[1] < 0.3 * plain[1] and fair[0] < plain[0] and fair[0] < 0.5
    model = train_toxicity(docs, labels, fairness=20.0)
    scored = score_toxicity(docs, model).join(labels, "doc_id").collect()
    assert sum((r.score >= 0.5) == bool(r.toxic) for r in scored) > 0.95 * len(scored)


def test_fit_separates_and_swaps_move_little():
    rows = [[0, 2], [1, 2], [0], [1], [2], []] * 20
    label = np.array([1.0, 1, 0, 0, 1, 0] * 20)
    b, w = fit_logistic(rows, label, [([0], [1])], 3, 1.0, 1e-4)
    assert b + w[2] > 0 > b and abs(w[0] - w[1]) < 0.1


def test_held_out_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = toxicity_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic for r in rows)
    toxic = [r for r in rows if r.toxic]
    clean = [r for r in rows if not r.toxic]
    assert right >= 0.97 * len(rows)
    assert sum(r.predicted for r in toxic) >= 0.85 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.01 * len(clean)


def test_odd_rows_and_labels(spark):
    docs = odd_documents(spark)
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity_scores(docs, empty).collect()
    assert len(rows) == len(TEXTS) and all(r.score == 0.5 and r.predicted == 1 for r in rows)
    mixed = spark.createDataFrame([(i, i % 2) for i in range(9)] + [(None, 1), (4, None)], empty.schema)
    rows = toxicity_scores(docs, mixed).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity_scores(no_documents(spark), mixed).count() == 0
