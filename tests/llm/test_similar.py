"""The pipeline's near-dedup against exact five-word similarity."""

import corpus_pipeline
import numpy as np
import pytest
from odd_rows import TEXTS, no_documents, odd_documents

from lumenbar.llm.similar import _Texts, keep_one, shingles


def plain(text, words=5):
    tokens = (text or "").encode().lower().split()
    return {tuple(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))}


def similarity(a, b):
    a, b = plain(a), plain(b)
    return len(a & b) / len(a | b)


def edited(rng, base, kind, part):
    n = len(base)
    new = rng.integers(0, 10**9, part).astype(str)
    at = int(rng.integers(1, n - part))
    passage, rest = base[at : at + part], np.concatenate([base[:at], base[at + part :]])
    if kind == "appended":
        return np.concatenate([base, new])
    if kind == "deleted":
        return rest
    if kind == "replaced":
        return np.concatenate([base[:at], new, base[at + part :]])
    return np.concatenate([passage, rest])


@pytest.fixture(scope="module")
def planted():
    """[(text, edited text, similarity)]: 0.8 to 0.85 and 0.5 to 0.75, whole passages edited."""
    rng = np.random.default_rng(7)
    out = {"near": [], "apart": []}
    for n in (100, 250, 600):
        for kind in ("appended", "deleted", "replaced", "moved"):
            made = {"near": 0, "apart": 0}
            while min(made.values()) < 25:
                base = rng.integers(0, 10**9, n).astype(str)
                other = edited(rng, base, kind, int(rng.integers(1, n // 2)))
                if kind == "moved" and n == 100:
                    other = other.copy()
                    other[rng.integers(0, n, 2)] = "x"
                a, b = " ".join(base), " ".join(other)
                s = similarity(a, b)
                name = "near" if 0.8 <= s < 0.85 else "apart" if 0.5 <= s < 0.75 else None
                if name is None and kind == "moved" and s >= 0.85:
                    name = "near"
                if kind == "moved" and made["near"] >= 25:
                    made["apart"] = 25  # a move changes too few shingles for that
                if name and made[name] < 25:
                    made[name] += 1
                    out[name].append((a, b))
    return out


def kept(spark, texts, stage):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id for r in stage(docs).select("doc_id").collect()}


def test_stage_links_edited_passages_and_no_others(spark, planted):
    def stage(docs):
        return corpus_pipeline.near(spark, docs, "")

    near = [t for pair in planted["near"] for t in pair]
    assert kept(spark, near, stage) == set(range(0, len(near), 2))
    apart = [t for pair in planted["apart"] for t in pair]
    assert kept(spark, apart, stage) == set(range(len(apart)))


@pytest.mark.parametrize("turns,block", [(0, 4096), (0, 7), (2, 4096), (2, 7)])
def test_crowded_groups_equal_brute_force(spark, monkeypatch, turns, block):
    """Copies of copies: hubs and pairs across labels give the components of all pairs."""
    monkeypatch.setattr("lumenbar.llm.similar.TURNS", turns)
    monkeypatch.setattr("lumenbar.llm.similar.BLOCK", block)
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(4):
        bases = [rng.integers(0, 10**6, 80).astype(str)]
        for _ in range(40):
            other = bases[rng.integers(0, len(bases))].copy()
            other[rng.integers(0, 80, rng.integers(1, 4))] = rng.integers(0, 10**6)
            bases.append(other)
        texts += [" ".join(b) for b in bases]
    label = list(range(len(texts)))
    pairs = [(i, j) for i in label for j in label[:i] if similarity(texts[i], texts[j]) >= 0.8]
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            low = min(label[i], label[j])
            changed |= label[i] != label[j]
            label[i] = label[j] = low
    assert 4 < len(set(label)) < len(texts)
    assert kept(spark, texts, keep_one) == set(label)


def test_odd_and_empty_tables(spark):
    docs = odd_documents(spark)
    out = keep_one(docs)
    assert out.columns == docs.columns and 0 < out.count() <= len(TEXTS)
    assert keep_one(no_documents(spark)).count() == 0
    assert len(shingles(b"", 5)) == len(shingles(b" a b ", 5)) == 1
    assert len(shingles(b"a b c d e f", 5)) == 2


def test_unlike_texts_with_one_passage_stay(spark):
    """A passage that 2,000 texts share puts them in common buckets, but links none."""
    rng = np.random.default_rng(8)
    passage = rng.integers(0, 10**9, 120).astype(str)
    texts = [
        " ".join(np.concatenate([passage, rng.integers(0, 10**9, 60).astype(str)]))
        for _ in range(2_000)
    ]
    assert 0.4 < similarity(texts[0], texts[1]) < 0.8
    assert len(kept(spark, [*texts, texts[7] + " x"], keep_one)) == 2_000


def test_crowds_are_not_listed_pair_by_pair(spark, monkeypatch):
    """Texts around one passage, most a little below the similarity: few pairs are confirmed
    one by one, however many anchors they meet at, and the links are those of all pairs."""
    listed = []
    confirmed = _Texts.confirmed

    def counted(self, candidates, alike):
        listed.append(candidates.count())
        return confirmed(self, candidates, alike)

    monkeypatch.setattr(_Texts, "confirmed", counted)
    rng = np.random.default_rng(11)
    passage = rng.integers(0, 10**9, 120).astype(str)
    texts = [
        " ".join(np.concatenate([passage, rng.integers(0, 10**9, own).astype(str)]))
        for own in (24, 40, 60)
        for _ in range(300)
    ]
    texts += [" ".join([*texts[i].split(), "x", "y"]) for i in range(0, 900, 100)]
    assert kept(spark, texts, keep_one) == set(range(900))
    assert sum(listed) < 6 * len(texts), listed


def test_short_texts_are_confirmed_however_far_apart(spark, monkeypatch):
    """Of few shingles one more may tip many bits: no bound on them decides."""
    monkeypatch.setattr("lumenbar.llm.similar.FAR", 0)
    short = ["a b c d e f g h i", "a b c d e f g h i j"]
    assert similarity(*short) >= 0.8
    assert kept(spark, short, keep_one) == {0}
