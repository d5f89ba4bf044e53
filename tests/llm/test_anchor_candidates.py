"""Near-dedup's candidates: anchor SimHash finds them, and nothing beside it."""

from pathlib import Path

import numpy as np

from lumenbar.llm import similar, simhash
from lumenbar.llm.components import components
from lumenbar.session import CLEANUP, cut_lineage, shuffles_deleted

SHAPE = "node long, label long, n long, " + ", ".join(f"{c} long" for c in similar.FP)


def test_only_anchors_give_candidates(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = [rng.integers(0, 10**6, 90).astype(str) for _ in range(20)]
    texts = [" ".join(t) for b in base for t in (b, [*b, "more"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert similar.keep_one(docs).count() == 20
    monkeypatch.setattr(similar, "TURNS", 0)
    found = simhash.near_pairs
    monkeypatch.setattr(simhash, "near_pairs", lambda *a: found(*a).where("false"))
    assert similar.keep_one(docs).count() == 40


def test_fingerprint_bits_are_majorities():
    hashes = np.unique(np.random.default_rng(1).integers(0, 2**64, 3000, np.uint64))
    whole = simhash.fingerprint_of_set(hashes, 8)
    ones = sum(
        np.unpackbits(simhash.fingerprint_of_set(hashes[i : i + 1], 8).view(np.uint8)).astype(int)
        for i in range(len(hashes))
    )
    assert (np.unpackbits(whole.view(np.uint8)) == (2 * ones > len(hashes))).all()
    other = simhash.fingerprint_of_set(np.random.default_rng(5).integers(0, 2**64, 3000, np.uint64), 8)
    assert 180 < np.bitwise_count((whole ^ other).view(np.uint64)).sum() < 330


def test_near_pairs_equal_brute_force(spark):
    """Every pair that meets at an anchor is listed, or connected as part of a crowd."""
    rng = np.random.default_rng(6)
    bits = np.concatenate(
        [base ^ (rng.random((size, 512)) < 0.1) for size in (2, 3, 40) for base in rng.random((1, 512)) < 0.5]
    )
    fps = np.packbits(bits, axis=1, bitorder="little").view("<i8")
    labels = [i if i % 7 else 0 for i in range(len(fps))]
    sizes = [100 if i % 5 else 60 for i in range(len(fps))]
    rows = [(i, labels[i], sizes[i], *map(int, f)) for i, f in enumerate(fps)]
    nodes = spark.createDataFrame(rows, SHAPE)

    want = set()
    for a in range(len(fps)):
        for b in range(a):
            apart = (bits[a] != bits[b]).reshape(8, 64)
            meet = min(apart[:, s : s + 15].sum(axis=1).min() for s in (0, 15, 30, 45)) <= 1
            if meet and apart[:2].sum() <= 40 and labels[a] != labels[b] and sizes[a] == sizes[b]:
                want.add((a, b))
    assert len(want) > 200
    for homes_per_task in (3, 4096):
        found = simhash.near_pairs(nodes, 40, 8, 15, 2, (4, 5), homes_per_task)
        found = found.collect()
        listed = {(r.a, r.b) for r in found if not r.crowd}
        assert listed <= want
        crowd = spark.createDataFrame([(r.a, r.b) for r in found if r.crowd], "a long, b long")
        root = {r.a: r.b for r in components(crowd).collect()}
        assert all(root.get(a, a) == root.get(b, b) for a, b in want - listed)


def test_crowd_of_unlinked_texts(spark, monkeypatch):
    """Texts a little below 0.8 among each other, dealt to cells, with some real copies."""
    monkeypatch.setattr(similar, "BLOCK", 40)
    rng = np.random.default_rng(4)
    base, texts = rng.integers(0, 10**6, 300).astype(str), []
    for i in range(150):
        words = base.copy()
        words[rng.choice(60, 6, replace=False) * 5] = [f"own{i}"] * 6
        texts.append(" ".join(words))
    texts += [f"{t} last" for t in texts[:5]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [similar.shingles(t.encode(), 5) for t in texts]
    alike = [
        len(np.intersect1d(a, b)) / len(np.union1d(a, b)) for i, a in enumerate(sets) for b in sets[:i]
    ]
    assert 5 <= sum(s >= 0.8 for s in alike) < 40 and sum(s >= 0.6 for s in alike) > 5_000
    label = list(range(len(texts)))
    pairs = [(i, j) for i in range(len(texts)) for j in range(i)]
    for _ in range(10):
        for (i, j), s in zip(pairs, alike):
            if s >= 0.8:
                label[i] = label[j] = min(label[i], label[j])
    for turns in (0, 2):
        monkeypatch.setattr(similar, "TURNS", turns)
        assert {r.doc_id for r in similar.keep_one(docs).select("doc_id").collect()} == set(label)


def test_texts_visit_only_anchors_below_their_home():
    """Of two fingerprints one bit apart each could visit the other's home: one visit is enough."""
    blocks = simhash.blocks_for(40, 1, 15)
    tables = {15: simhash.code_tables(15)}
    fps = np.random.default_rng(9).integers(-(2**63), 2**63, (400, 1))
    rows = {once: list(simhash._anchors(fps, blocks, tables, once)) for once in (False, True)}
    size = {once: sum(len(at) for _, at, _ in found) for once, found in rows.items()}
    assert size[True] < 0.55 * size[False]
    for bit in range(60):
        other = list(simhash._anchors(fps ^ (1 << bit), blocks, tables, True))
        came = [set(zip(a.tolist(), at.tolist())) for a, at, _ in (*rows[True], *other)]
        mine, theirs = set().union(*came[: len(rows[True])]), set().union(*came[len(rows[True]) :])
        assert {at for _, at in mine & theirs} == set(range(len(fps)))


def test_a_pair_is_listed_where_it_meets_first(spark):
    fps = np.zeros((2, 8), np.int64)
    fps[1, 7] = 1
    rows = [(i, i, 100, *map(int, f)) for i, f in enumerate(fps)]
    nodes = spark.createDataFrame(rows, SHAPE)
    blocks = simhash.blocks_for(40, 8, 15)
    columns = ["node", "label", "n", "fp0", "fp1"]
    at_anchors = simhash._at_anchors(nodes, columns, blocks, 4096, once=True)
    found = at_anchors.mapInArrow(
        simhash._compare(simhash._pairs(40, (4, 5), blocks)), "a long, b long, crowd boolean"
    )
    assert [tuple(r) for r in found.collect()] == [(1, 0, False)]


def test_shuffle_files_of_a_step_go_with_it(spark):
    def files():
        return sum(1 for _ in root.rglob("shuffle_*.data"))

    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    root = Path(manager.localDirs()[0].getPath())
    before = spark.conf.get(CLEANUP)
    with shuffles_deleted(spark):
        had = files()
        assert cut_lineage(spark.range(1000).repartition(3, "id")).count() == 1000
        assert files() <= had
    assert spark.conf.get(CLEANUP) == before
