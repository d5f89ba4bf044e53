import random
import re
import zlib
from collections import Counter

import pytest
from odd_rows import TEXTS, no_documents, odd_documents

from lumenbar.llm.spelling import near_words, prefix_distance, roots, scan, spelling_forms, vocabulary


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def plain_near(words):
    """All pairs of words compared."""
    return {
        (a, b) for a in words for b in words
        if a != b and abs(len(a) - len(b)) <= 1 and distance(a, b) == 1
    }


def plain_vocabulary(rows, noise=199):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if noise and h % noise == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def plain_forms(counts):
    near = {}
    for a, b in plain_near(counts):
        near.setdefault(a, []).append(b)
    form = {}
    for w, n in counts.items():
        best = min(near.get(w, []), key=lambda b: (-counts[b], b), default=None)
        form[w] = best if best and counts[best] >= 5 * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        f = form[w]
        out.append((w, f, root, n, len(near.get(w, [])), counts[f] if f else None))
    return sorted(out)


def some_words(seed, letters, n, longest):
    rng, words = random.Random(seed), set()
    while len(words) < n:
        if words and rng.random() < 0.6:
            w = rng.choice(sorted(words))
            p, kind = rng.randrange(len(w)), rng.randrange(3)
            w = w[:p] + (rng.choice(letters) if kind else "") + w[p + (kind != 1) :]
        else:
            w = "".join(rng.choice(letters) for _ in range(rng.randint(6, longest)))
        if len(w) >= 6:
            words.add(w)
    return sorted(words)


@pytest.mark.parametrize("letters,longest", [("ab", 9), ("abé", 30), ("abcdefÿ", 8)])
def test_scan_finds_pairs_that_share_their_first_half(letters, longest):
    words = some_words(1, letters, 300, longest)
    listed = sorted(w.encode("latin-1") for w in words)
    want = set()
    for a, b in plain_near(words):
        half = min(len(a), len(b)) // 2
        if a[:half] == b[:half]:
            want.add((a, b))
    found = [(listed[q].decode("latin-1"), listed[at].decode("latin-1")) for q, at in scan(listed, None, 6)]
    assert len(found) == len(set(found)) and set(found) == want
    # two lists: the same pairs, asked from the first
    asked, rest = listed[::2], listed[1::2]
    across = {(asked[q], rest[at]) for q, at in scan(rest, asked, 6)}
    assert {(a.decode("latin-1"), b.decode("latin-1")) for a, b in across} == {
        (a, b) for a, b in want if a.encode("latin-1") in asked and b.encode("latin-1") in rest
    }


@pytest.mark.parametrize("size", [7, 10_000])
def test_slices_lose_and_repeat_no_pair(spark, size):
    # half of the words share their first and last letters: their range covers many slices
    words = some_words(2, "abc", 120, 9)
    words += ["prefix" + w + "suffix" for w in words]
    frame = spark.createDataFrame([(w, i + 5) for i, w in enumerate(words)], "word string, n long")
    rows = near_words(frame, size=size).collect()
    count = {w: i + 5 for i, w in enumerate(words)}
    pairs = [(r.word, r.near) for r in rows]
    assert len(pairs) == len(set(pairs)) and set(pairs) == plain_near(words)
    assert all(r.near_n == count[r.near] for r in rows)


def test_documents_equal_brute_force(spark):
    rng = random.Random(5)
    words = some_words(3, "aeinst", 60, 9) + ["Été" + w for w in some_words(4, "ae", 10, 7)]
    rows = [
        (i, " ".join(rng.choices(words, [2 ** (k % 9) for k in range(len(words))], k=80)).title())
        for i in range(60)
    ]
    rows += [(i, t) for i, t, _ in TEXTS if i != 6] + [(6, "lorem Ipsum dolor sit amet " * 900)]
    rows += [(None, "naïveté×÷ " * 9), (3, "ab1cdefgh_ijklmn " * 6), (70, "z" * 20_000 + " ")] * 5
    docs = odd_documents(spark, [(i, t, None) for i, t in rows])
    counts = plain_vocabulary(rows)
    assert {(r.word, r.n) for r in vocabulary(docs).collect()} == set(counts.items())
    for size in (9, 20_000):
        found = spelling_forms(docs, size=size)
        assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        assert sorted((tuple(r) for r in found.collect()), key=str) == sorted(plain_forms(counts), key=str)
    assert any(f[1] for f in plain_forms(counts))


def test_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    counts = plain_vocabulary(rows)
    got = sorted((tuple(r) for r in spelling_forms(docs.repartition(5)).collect()), key=str)
    assert got == sorted(plain_forms(counts), key=str) and len(got) > 100


def test_chains_end_at_their_last_form(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(13)] + [("x", "w13")]
    found = roots(spark.createDataFrame(forms, "word string, form string")).collect()
    assert {r.root for r in found} == {"w13"} and len(found) == 14


def test_slice_beginnings_and_empty_tables(spark):
    assert prefix_distance(b"abc", b"abxd") == 1 and prefix_distance(b"abc", b"bcd") == 1
    assert prefix_distance(b"", b"abc") == 0 and prefix_distance(b"xyz", b"abc") == 3
    assert spelling_forms(no_documents(spark)).count() == 0
    one = spark.createDataFrame([(1, "single " * 5)], "doc_id long, text string")
    assert [tuple(r) for r in spelling_forms(one, noise=None).collect()] == [
        ("single", None, "single", 5, 0, None)
    ]
