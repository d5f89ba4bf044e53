"""Spelling variants: words one edit apart, found by scanning the sorted vocabulary.

Two words one edit apart share their first half or their last half (of the shorter one's
length, rounded down and up). So the vocabulary is sorted twice, as it is and reversed, and
each pair is looked for where it shares the half it must share.

A sorted list is cut into slices of about ``SLICE`` words by range. A task scans one slice:
it walks the words in order and keeps, for each depth of the current word, a row of the
banded edit matrix (three cells) for all words still within one edit of that prefix. The next
word reuses the rows up to its common prefix with the last one; a range of words whose shared
prefix is beyond one edit of all others is skipped. Words whose half also starts words of
later slices meet those slices one by one, slice against slice, so no task holds more than two
slices, however many words share a half; slices whose common beginning is already two edits
away are not met.

Only slice bounds come to the driver, at most ``SLICES`` of them. Words are Latin letters, so
one byte each in Latin-1, whose order is the code points' order.

Defined results: words are maximal runs of the letters A-Z, a-z and U+00C0 to U+00FF of whole
texts, A-Z lower-cased, after the seeded deletion (below), of at least six code points and
five occurrences. NULL text has no words; a NULL id is written as the empty text in the seed;
rows that repeat count again. A table without such words gives no rows. Only id and text are
read, so other columns may have any name.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenbar.llm.common import UPPER, whole
from lumenbar.session import cut_lineage

LETTERS = r"[A-Za-zÀ-ÿ]"
#: One run in so many loses a letter, chosen by crc32 of "<id>:<run>".
NOISE = 199
#: Words of a slice, and the most slices.
SLICE, SLICES = 20_000, 4096


def vocabulary(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_length: int = 6,
    least_count: int = 5,
    noise: int | None = NOISE,
) -> DataFrame:
    """(word, n): the words and how often they occur; counts combine in the map tasks."""
    text = F.translate(whole(F.col(text_col)), UPPER, UPPER.lower())
    # shorter runs give no word, and a deletion only shortens
    runs = F.regexp_extract_all(text, F.lit(f"({LETTERS}{{{least_length},}})"), F.lit(1))
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run")
    )
    word = F.col("run")
    if noise:
        h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
        at = (h % F.length("run")).cast("int")
        without = F.concat(
            F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run"))
        )
        word = F.when(h % noise == 0, without).otherwise(word)
    counts = rows.select(word.alias("word")).where(F.length("word") >= least_length)
    counts = counts.groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= least_count)


def common_prefix(a: bytes, b: bytes) -> int:
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    low, high = 0, most  # a[:low] equal, a[:high] not
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid)
    return low


def half_of(length: int | np.ndarray, least: int) -> int | np.ndarray:
    """Letters that a word certainly shares with a near word when the edit is behind them.

    The near word may be shorter by one, but no word is shorter than ``least``.
    """
    return np.maximum(least, np.asarray(length) - 1) // 2


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The banded edit row as one number, and what it becomes.

    A row has three cells: the asked word's beginning with one letter fewer than the listed
    one's, as many, and one more; each 0, 1 or 2 (two and more). ``following[8 * row + code]``
    is the row one listed letter deeper, where ``code`` says which of the asked letters before,
    at and behind that place differ from it; ``distance[5 * row + gap + 2]`` the cell at the
    end of words whose lengths differ by ``gap``; ``least`` the smallest cell.
    """
    rows = [(r // 9, r // 3 % 3, r % 3) for r in range(27)]
    following = np.empty((27, 8), np.int16)
    for r, (fewer, equal, more) in enumerate(rows):
        for code in range(8):
            a = min(fewer + (code >> 2), equal + 1)
            b = min(equal + (code >> 1 & 1), more + 1, a + 1)
            c = min(more + (code & 1), b + 1)
            following[r, code] = 9 * min(a, 2) + 3 * min(b, 2) + min(c, 2)
    distance = np.full((27, 5), 2, np.int8)
    distance[:, 1:4] = rows
    return following.ravel(), distance.ravel(), np.array([min(r) for r in rows])


FOLLOWING, DISTANCE, LEAST = _tables()
#: The row where both beginnings are equal, and all rows by that cell.
EQUAL_ROW = 9 + 1
SAME = np.arange(27) // 3 % 3 == 0


class Words:
    """Sorted byte strings in one buffer, with blanks around each."""

    def __init__(self, words: list[bytes]) -> None:
        self.words = words
        self.length = np.array([len(w) for w in words], np.int64)
        self.start = 1 + np.concatenate([[0], np.cumsum(self.length + 2)])[:-1].astype(np.int64)
        self.buffer = np.frombuffer(b"\0" + b"\0\0".join([*words, b""]) + b"\0", np.uint8)
        self._codes: dict[int, np.ndarray] = {}

    def codes(self, letter: int) -> np.ndarray:
        """For each place: which letters before, at and behind it differ from ``letter``."""
        if letter not in self._codes:
            other = np.concatenate([[1], (self.buffer != letter).astype(np.int8), [1]])
            self._codes[letter] = (4 * other[:-2] + 2 * other[1:-1] + other[2:]).astype(np.int16)
        return self._codes[letter]


def scan(listed: list[bytes], asked: list[bytes] | None, least: int) -> Iterator[tuple[int, int]]:
    """(asked, listed) positions of words one edit apart that share their first half.

    Both lists are sorted and without repeats; None asks the listed words themselves. Each
    pair comes out once for each asked word.
    """
    same = asked is None
    queries = Words(listed if same else asked)
    words = queries.words
    half = half_of(queries.length, least)
    floor = least // 2  # every pair shares this much
    alone = 1 if same else 0
    # by depth: asked words within one edit of the listed word's beginning, and their rows
    kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    deepest, last = 0, b""
    for at, word in enumerate(listed):
        depth = min(common_prefix(last, word), deepest)
        last = word
        if depth < floor:
            depth, head = floor, word[:floor]
            first = bisect_left(words, head)
            ids = np.arange(first, bisect_right(words, head, first, key=lambda w: w[:floor]))
            kept[floor] = (ids, np.full(len(ids), EQUAL_ROW, np.int16))
        ids, row = kept[depth]
        while depth < len(word) and len(ids) > alone:
            code = queries.codes(word[depth]).take(queries.start.take(ids) + depth)
            row = FOLLOWING.take(8 * row + code)
            depth += 1
            close = SAME.take(row) | (half.take(ids) < depth)
            close &= LEAST.take(row) <= 1
            ids, row = ids[close], row[close]
            kept[depth] = (ids, row)
        deepest = depth
        if depth < len(word):
            continue  # the range that starts like this holds no other word
        gap = np.clip(queries.length.take(ids) - len(word), -2, 2)
        for q in ids[DISTANCE.take(5 * row + gap + 2) == 1].tolist():
            other = words[q]
            if common_prefix(other, word) >= min(len(other), len(word)) // 2:
                yield q, at


def _slices(vocab: DataFrame, reverse: bool, size: int) -> tuple[DataFrame, list[tuple[str, str]]]:
    """(s, word, n, slice) sorted by range of s, and each slice's first and last s."""
    total = vocab.count()
    number = max(1, min(SLICES, math.ceil(total / size)))
    s = F.reverse("word") if reverse else F.col("word")
    ranged = cut_lineage(
        vocab.select(s.alias("s"), "n")
        .repartitionByRange(number, "s")
        .withColumn("slice", F.spark_partition_id())
    )
    bounds = ranged.groupBy("slice").agg(F.min("s").alias("low"), F.max("s").alias("high"))
    found = sorted(tuple(r) for r in bounds.collect())
    renumbered = {old: new for new, (old, _, _) in enumerate(found)}
    mapping = F.create_map(*[F.lit(x) for pair in renumbered.items() for x in pair]) if found else None
    if mapping is not None:
        ranged = ranged.withColumn("slice", F.element_at(mapping, F.col("slice")))
    return ranged, [(low, high) for _, low, high in found]


def prefix_distance(prefix: bytes, word: bytes) -> int:
    """Least edits between ``prefix`` and any beginning of ``word``."""
    row = np.arange(len(word) + 1)
    for c in prefix:
        new = np.empty_like(row)
        new[0] = row[0] + 1
        for j in range(1, len(row)):
            new[j] = min(row[j - 1] + (word[j - 1] != c), row[j] + 1, new[j - 1] + 1)
        row = new
    return int(row.min())


def _routes(bounds: list[tuple[str, str]], least: int):
    """Rows with the pair of slices in which they are asked or listed."""
    lows = [low.encode("latin-1") for low, _ in bounds]
    highs = [high.encode("latin-1") for _, high in bounds]
    heads = [low[: common_prefix(low, high)] for low, high in zip(lows, highs)]
    floor = least // 2
    # slices that words of an earlier slice may reach
    reached: list[list[int]] = [[] for _ in bounds]
    for i, high in enumerate(highs):
        j = i + 1
        while j < len(bounds) and common_prefix(high, lows[j]) >= floor:
            reached[j].append(i)
            j += 1

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for s, n, k in zip(frame["s"], frame["n"], frame["slice"]):
                rows.append((s, n, k, k, True))
                rows.extend((s, n, i, k, True) for i in reached[k])
                word, j = s.encode("latin-1"), k + 1
                head = word[: int(half_of(len(word), least))]
                while j < len(lows) and lows[j].startswith(head):
                    if prefix_distance(heads[j], word[: len(heads[j]) + 1]) <= 1:
                        rows.append((s, n, k, j, False))
                    j += 1
            yield pd.DataFrame(rows, columns=["s", "n", "asks", "lists", "listed"])

    return run


LINKS = "word string, near string, near_n long"


def _pairs(reverse: bool, least: int):
    def text(s: bytes) -> str:
        return (s[::-1] if reverse else s).decode("latin-1")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        asks, lists = frame["asks"].iloc[0], frame["lists"].iloc[0]
        encoded = frame["s"].map(lambda s: s.encode("latin-1"))
        count = dict(zip(encoded, frame["n"]))
        listed = sorted(encoded[frame["listed"]])
        asked = None if asks == lists else sorted(encoded[~frame["listed"]])
        rows = []
        if asked is None or asked:
            ask = listed if asked is None else asked
            for q, at in scan(listed, asked, least):
                a, b = ask[q], listed[at]
                shorter = min(len(a), len(b))
                if reverse and common_prefix(a[::-1], b[::-1]) >= shorter // 2:
                    continue  # found in the other list
                rows.append((text(a), text(b), count[b]))
                if asked is not None:
                    rows.append((text(b), text(a), count[a]))
        return pd.DataFrame(rows, columns=["word", "near", "near_n"])

    return run


def near_words(vocab: DataFrame, least: int = 6, size: int = SLICE) -> DataFrame:
    """(word, near, near_n): every ordered pair of words exactly one edit apart, once.

    Pairs that share their first half come from the sorted list, all others from the
    reversed one.
    """
    found = []
    for reverse in (False, True):
        ranged, bounds = _slices(vocab, reverse, size)
        routed = ranged.mapInPandas(
            _routes(bounds, least), "s string, n long, asks int, lists int, listed boolean"
        )
        links = routed.groupBy("asks", "lists").applyInPandas(_pairs(reverse, least), LINKS)
        found.append(links)
    return found[0].unionByName(found[1])


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) -> (word, root): the last of each chain of forms.

    A form is at least five times as frequent as its word, so chains are short and end.
    """
    now = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = cut_lineage(
            now.join(further, "root", "left").select(
                "word",
                F.coalesce("next", "root").alias("root"),
                F.col("next").isNotNull().alias("moved"),
            )
        )
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.drop("moved")


def spelling_forms(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    ratio: int = 5,
    least_length: int = 6,
    least_count: int = 5,
    noise: int | None = NOISE,
    size: int = SLICE,
) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary."""
    vocab = cut_lineage(vocabulary(docs, id_col, text_col, least_length, least_count, noise))
    near = near_words(vocab, least_length, size)
    # largest n, then the first in code-point order
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("form")))
    near = near.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    known = cut_lineage(
        vocab.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(-F.col("best.minus") >= ratio * F.col("n"), F.col("best")).alias("best"),
        )
    ).select("word", "n", "n_near", F.col("best.form").alias("form"), (-F.col("best.minus")).alias("form_n"))
    ends = roots(known.where("form IS NOT NULL"))
    return known.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
