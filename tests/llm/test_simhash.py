import numpy as np
import pytest
import xxhash
from odd_rows import TEXTS, no_documents, odd_documents
from pyspark.sql import functions as F

from lumenbar.llm.components import components, local_forest
from lumenbar.llm.simhash import blocks_for, code_tables, keep_one, linked_nodes, near_duplicate_groups


def plain_fingerprint(text, words=4):
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    n = max(1, len(tokens) - words + 1)
    hashes = [xxhash.xxh64_intdigest(b" ".join(tokens[i : i + words]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def plain_components(pairs):
    """(id, fingerprint) -> smallest reachable id, by comparing everything."""
    label = {i: i for i, _ in pairs}
    changed = True
    while changed:
        changed = False
        for i, a in pairs:
            for j, b in pairs:
                if bin(a ^ b).count("1") <= 4 and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_odd_rows(spark):
    rows = near_duplicate_groups(odd_documents(spark)).collect()
    assert len(rows) == len(TEXTS)
    texts = {i: t for i, t, _ in TEXTS if i != 6}
    for r in rows:
        if r.doc_id in texts:
            assert r.fingerprint == f"{plain_fingerprint(texts[r.doc_id]):016x}"
    got = {r.doc_id: r.component_id for r in rows}
    # no words: fingerprint zero, linked like any other; a NULL id names no component
    assert got[3] == got[4] == got[5] == 3 and got[1] == got[2] == 1 and got[None] is None


def test_components_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = near_duplicate_groups(docs).collect()
    pairs = [(r.doc_id, int(r.fingerprint, 16)) for r in rows]
    assert {r.doc_id: r.component_id for r in rows} == plain_components(pairs)


@pytest.mark.parametrize("homes_per_task", [2, 4096])
def test_no_link_is_lost(spark, homes_per_task):
    rng = np.random.default_rng(4)
    fps = set()
    for _ in range(40):
        seed = int(rng.integers(-(2**63), 2**63))
        for _ in range(8):
            x = seed
            for b in rng.choice(64, rng.integers(0, 5), replace=False):
                x ^= 1 << int(b) if b < 63 else -(1 << 63)
            fps.add(x)
    fps = sorted(fps)
    nodes = spark.createDataFrame(list(enumerate(fps)), "node long, fp0 long")
    links = linked_nodes(nodes, 4, homes_per_task=homes_per_task)
    found = {r.a: r.b for r in components(links).collect()}
    want = plain_components([(i, f & (2**64 - 1)) for i, f in enumerate(fps)])
    assert {i: found.get(i, i) for i in want} == want


def test_covering_code():
    for n in (3, 7, 15):
        home, near = code_tables(n)
        for w in np.random.default_rng(n).integers(0, 1 << n, 60):
            assert bin(int(w) ^ int(home[w])).count("1") <= 1 and home[home[w]] == home[w]
            want = {int(home[w])} | {int(home[w ^ (1 << b)]) for b in range(n)}
            assert want == {int(x) for x in near[w]} | {int(home[w])}
    assert sum(b.code + b.plain for b in blocks_for(4)) == 64 and len(blocks_for(4)) == 3
    assert len(blocks_for(23, 2, 16)) == 8
    with pytest.raises(ValueError):
        blocks_for(4, lanes=2)


def test_star_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7)]
    out = components(spark.createDataFrame(chain, "a long, b long")).collect()
    assert {r.a: r.b for r in out} == {i: 0 for i in range(1, 51)} | {101: 100}
    a, b = local_forest(np.array([5, 9, 3]), np.array([4, 5, 3]))
    assert dict(zip(a.tolist(), b.tolist())) == {5: 4, 9: 4}


def test_stage_catches_near_copies_and_leaves_others(spark):
    rng = np.random.default_rng(1)
    words = np.array([f"w{i}" for i in range(5000)])
    texts, planted = [], set()
    for i in range(300):
        base = rng.choice(words, 250)
        texts.append(" ".join(base))
        if i % 10 == 0:
            copy = base.copy()
            copy[rng.choice(250, 4, replace=False)] = "changed"  # about 0.86 of the shingles
            planted.add(len(texts))
            texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {
        r.doc_id
        for r in keep_one(docs, words=3, distance=23, lanes=2, width=16).select("doc_id").collect()
    }
    gone = set(range(len(texts))) - kept
    assert gone <= planted and len(gone) >= 0.95 * len(planted)


def test_keep_one_has_all_columns_and_empty_tables(spark):
    docs = odd_documents(spark)
    out = keep_one(docs)
    assert out.columns == docs.columns
    assert out.where(F.col("doc_id").isin(2, 4, 5)).count() == 0
    assert near_duplicate_groups(no_documents(spark)).count() == 0
    assert keep_one(no_documents(spark)).count() == 0
