"""Toxicity by a counterfactual-regularised classifier.

A logistic model over the words of a text and the beginnings of its words. For labelled
texts that name a group of people, a second version is made in which the name is swapped
for another of its kind, and training penalises the squared change of the logit. Names of
groups thus get near-equal weights, and neutral mentions are not taken for toxic ones.

Defined results: NULL text is the empty text and scores as the intercept; without labels,
or with labels of one kind only, every score is the share of positive labels (0.5 without
labels). Texts that repeat enter training once. Only id and text are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenbar.llm.common import crc_fold, whole
from lumenbar.llm.labelled import label_sample, labelled
from lumenbar.session import cut_lineage

LETTERS = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)
#: Names of groups by kind; each is swapped for the next of its kind.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "natives", "refugees", "foreigners"),
    ("disabled", "blind", "deaf", "autistic"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
)
SWAP = {t: kind[(i + 1) % len(kind)] for kind in IDENTITY_TERMS for i, t in enumerate(kind)}
#: Words remembered by a task; the memory is emptied when full.
REMEMBERED = 200_000


def features_of(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def words_of(text: str) -> set[str]:
    return set(LETTERS.findall(text.lower()))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = (Counter(), Counter())
        for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
            seen[int(label > 0.5)].update({f for w in words_of(text.as_py()) for f in features_of(w)})
        names = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(names, pa.string()),
                pa.array([seen[1][f] for f in names], pa.int64()),
                pa.array([seen[0][f] for f in names], pa.int64()),
            ],
            ["feature", "pos", "neg"],
        )


def _found(words: set[str], index: dict[str, int]) -> list[int]:
    return sorted({index[f] for w in words for f in features_of(w) if f in index})


def _indexed(index: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain, swapped = [], []
            for text in batch.column(0):
                words = words_of(text.as_py())
                plain.append(_found(words, index))
                named = words & SWAP.keys()
                other = (words - named) | {SWAP[w] for w in named}
                swapped.append(_found(other, index) if named else None)
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(plain, kind), pa.array(swapped, kind)],
                ["label", "plain", "swapped"],
            )

    return run


@dataclass(frozen=True)
class ToxicityModel:
    intercept: float
    weights: dict[str, float]


def _ragged(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(row number, feature) of every entry."""
    count = np.array([len(r) for r in rows], np.int64)
    return (
        np.repeat(np.arange(len(rows)), count),
        np.array([i for r in rows for i in r], np.int64),
    )


def fit_logistic(
    plain: list[list[int]],
    label: np.ndarray,
    pairs: list[tuple[list[int], list[int]]],
    size: int,
    fairness: float,
    ridge: float,
    rounds: int = 400,
    scale: np.ndarray | None = None,
) -> tuple[float, np.ndarray]:
    """Weights that minimise log loss + ridge + fairness * mean squared logit change.

    Accelerated gradient steps; ``pairs`` are what a text and
    its swapped version have on their own. ``scale`` is
    the size of a feature: what is telling by itself needs a smaller weight.
    """
    scale = np.ones(size) if scale is None else scale
    row, col = _ragged(plain)
    n, m = len(plain), max(len(pairs), 1)
    prow, pcol = _ragged([a for a, _ in pairs])
    srow, scol = _ragged([b for _, b in pairs])
    prow, pcol = np.concatenate([prow, srow]), np.concatenate([pcol, scol])
    sign = np.concatenate([np.ones(len(prow) - len(srow)), -np.ones(len(srow))])
    w, b = np.zeros(size), math.log(label.mean() / (1 - label.mean()))
    fast, velocity = w.copy(), np.zeros(size)
    # diagonal scaling: rare features may move as far as common ones
    curve = scale**2 * np.bincount(col, minlength=size) / (4 * n) + ridge
    if pairs:
        curve += 2 * fairness * scale**2 * np.bincount(pcol, minlength=size) / m
    step = 1.0 / (np.maximum(curve, 1e-6) * max(1.0, len(row) / n) ** 0.5)
    for k in range(rounds):
        fast = w + 0.9 * velocity
        now = scale * fast
        logit = b + np.bincount(row, now[col], minlength=n)
        off = 1.0 / (1.0 + np.exp(-np.clip(logit, -30, 30))) - label
        slope = scale * np.bincount(col, off[row], minlength=size) / n + ridge * fast
        if pairs:
            change = np.bincount(prow, sign * now[pcol], minlength=m)
            pull = np.bincount(pcol, sign * change[prow], minlength=size) / m
            slope += 2 * fairness * scale * pull
        velocity = 0.9 * velocity - 0.1 * step * slope
        w = w + velocity
        b -= 1.0 * off.mean()
    return b, scale * w


def train_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    max_rows: int = 20_000,
    max_features: int = 1_000,
    min_rows: int = 3,
    fairness: float = 1.0,
    ridge: float = 1e-4,
) -> ToxicityModel:
    """Fits on at most about ``max_rows`` labelled rows and ``max_features`` features.

    Features are counted over the sample in Spark and ranked there; the driver gets the
    best ones and, per row of the sample, which of them it has.
    """
    sample = label_sample(labels, label_col, id_col, max_rows)
    own = docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text"))
    rows = labelled(own, sample, "id").select("text", "label")
    # copies of one text would make all its words look telling
    rows = cut_lineage(rows.dropDuplicates(["text"]))
    count, mean = rows.agg(F.count("*"), F.avg("label")).first()
    if not count or mean in (0.0, 1.0):
        share = min(max(mean if count else 0.5, 1e-6), 1 - 1e-6)
        return ToxicityModel(math.log(share / (1 - share)), {})
    positives = count * mean
    p, q = F.col("pos"), F.col("neg")
    expected = (p + q) * mean
    gain = p * F.log((p + 0.01) / expected) + q * F.log((q + 0.01) / ((p + q) - expected))
    ranked = (
        rows.mapInArrow(_count, "feature string, pos long, neg long")
        .groupBy("feature")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .where((p + q >= min_rows) & (p < positives + 1))
        .orderBy(F.desc(gain), "feature")
        .limit(max_features)
        .collect()
    )
    names = list(dict.fromkeys([r["feature"] for r in ranked] + sorted(SWAP)))
    index = {f: i for i, f in enumerate(names)}
    found = rows.mapInArrow(
        _indexed(index), "label double, plain array<int>, swapped array<int>"
    ).collect()
    # what both versions have does not change the logit
    pairs = [
        (sorted(set(r["plain"]) - set(r["swapped"])), sorted(set(r["swapped"]) - set(r["plain"])))
        for r in found
        if r["swapped"] is not None
    ]
    # log ratio of a feature's shares in toxic and other texts; names not seen have none
    scale = np.ones(len(names))
    for i, r in enumerate(ranked):
        share = (r["pos"] + 0.5) / (positives + 1), (r["neg"] + 0.5) / (count - positives + 1)
        scale[i] = abs(math.log(share[0] / share[1]))
    b, w = fit_logistic(
        [r["plain"] for r in found],
        np.array([r["label"] for r in found]),
        pairs,
        len(names),
        fairness,
        ridge,
        scale=scale,
    )
    return ToxicityModel(float(b), {f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-6})


def _score(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            out = []
            for text in batch.column(1):
                hits: set[str] = set()
                for word in words_of(text.as_py()):
                    found = known.get(word)
                    if found is None:
                        if len(known) > REMEMBERED:
                            known.clear()
                        found = known[word] = tuple(
                            f for f in features_of(word) if f in model.weights
                        )
                    if found:
                        hits.update(found)
                logit = model.intercept + math.fsum(model.weights[f] for f in hits)
                out.append(1.0 / (1.0 + math.exp(-min(max(logit, -500.0), 500.0))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.float64())], ["id", "score"]
            )

    return run


def score_toxicity(
    docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, score) of every whole text; the model has a bounded number of weights."""
    rows = docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_score(model), f"id {kind}, score double").withColumnRenamed("id", id_col)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = train_toxicity(docs, labels)
    return score_toxicity(docs, model).select(
        "doc_id",
        (crc_fold() == 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
