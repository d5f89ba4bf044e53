"""Scoring documents with a recurrent language model learned from the corpus.

Counts of all words of all training documents are gathered in Spark. The most frequent
words are the model's output words; every other word belongs to a class by its ending and
takes its corpus share of that class, with room for words never seen.

The recurrent weights learn from every training document, whole. In a pass, documents are
dealt by a hash of id and text to groups of about ``deal_tokens`` tokens; a task runs
truncated backpropagation over its group from the weights of the pass before, and the
groups' weights are averaged by their tokens, in two levels of sums. The driver holds one
set of weights. How the table is partitioned does not matter, but for rows that repeat id
and text: they are numbered inside a task so that a row repeated often spreads over groups.

A dictionary of at most ``dictionary`` words goes to the tasks. Counts of the words outside
it enter a score as one term each, log10(c + 0.5), which is added by a join, so the
vocabulary may have any size.

Defined results: NULL text is the empty text, which is its end token; repeated rows score
alike; ids that are NULL count as training rows; an empty table gives no rows; without
training tokens the model is uniform over its classes. Only id and text are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenbar.llm import recurrent
from lumenbar.llm.common import crc_fold, whole
from lumenbar.session import cut_lineage

#: The end of a document; no word holds white space.
END = b"\n"
#: Words a task counts before it passes them on.
COUNTED = 400_000
#: Documents scored side by side at most, by their number and by their tokens.
STEP_TOKENS = 2_000_000


@dataclass(frozen=True)
class LmSettings:
    held_out_fold: int = 1
    heads: int = 2_000
    head_classes: int = 30
    tails: int = 63
    dictionary: int = 150_000
    hidden: int = 32
    passes: int = 1
    deal_tokens: int = 4_000_000
    seed: int = 9


def tokens_of(text: bytes) -> list[bytes]:
    """Words, A-Z in lower case, then the end. ``bytes`` methods know ASCII only, and split
    at exactly the six ASCII white-space characters."""
    words = text.lower().split()
    words.append(END)
    return words


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())],
            ["word", "c"],
        )

    seen: Counter = Counter()
    for batch in batches:
        for text in batch.column(0):
            seen.update(tokens_of(text.as_py()))
            if len(seen) > COUNTED:
                yield out()
                seen.clear()
    if seen:
        yield out()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over whole texts, counted in the tasks before the exchange."""
    return texts.mapInArrow(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _level(c: Column) -> Column:
    return F.floor(F.log2(c.cast("double")) * 8)


@dataclass
class Vocabulary:
    """The bounded part of the vocabulary that tasks hold."""

    codes: dict[bytes, int]
    symbol: np.ndarray  # of a dictionary word
    log_count: np.ndarray  # log10(c + 0.5) of a dictionary word
    endings: dict[bytes, int]  # last two bytes -> rare class; others: the last class
    log_mass: np.ndarray  # log10 of a rare class's mass
    layout: recurrent.Layout
    total: int
    distinct: int

    def tail_of(self, word: bytes) -> int:
        return self.endings.get(word[-2:], self.layout.tails - 1)


def build_vocabulary(counts: DataFrame, settings: LmSettings) -> tuple[Vocabulary, np.ndarray, int]:
    """Vocabulary, mass of every symbol, and the lowest count level of the dictionary.

    To the driver come: totals, a histogram of count levels (a few hundred), masses by the
    last two bytes (65,792 at most) and the dictionary.
    """
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    levels = sorted(
        counts.groupBy(_level(F.col("c")).alias("l")).agg(F.count("*").alias("n")).collect(),
        key=lambda r: -r["l"],
    )
    lowest, room = math.inf, settings.dictionary
    for r in levels:
        room -= r["n"]
        if room < 0:
            break
        lowest = r["l"]
    known = []
    if lowest < math.inf:
        known = [
            (bytes(r["word"]), r["c"])
            for r in counts.where(_level(F.col("c")) >= int(lowest)).toLocalIterator()
        ]
    known.sort(key=lambda x: (-x[1], x[0]))
    heads = known[: settings.heads]
    if not heads:
        heads = [(END, 0)]
        known = known or heads
    # classes of about equal sums of square roots of counts
    roots = np.cumsum([math.sqrt(c + 0.5) for _, c in heads])
    which = np.minimum((roots / roots[-1] * settings.head_classes).astype(int), settings.head_classes - 1)
    edges = np.unique(np.concatenate([[0], np.nonzero(np.diff(which))[0] + 1, [len(heads)]]))
    masses = {
        bytes(r["ending"]): r["mass"]
        for r in counts.groupBy(F.substring("word", -2, 2).alias("ending"))
        .agg(F.sum(F.col("c") + 0.5).alias("mass"))
        .collect()
    }
    for w, c in heads:
        masses[w[-2:]] = masses.get(w[-2:], 0.0) - (c + 0.5)
    ranked = sorted(masses.items(), key=lambda x: (-x[1], x[0]))
    endings = {e: i for i, (e, m) in enumerate(ranked[: settings.tails - 1]) if m > 0.25}
    tails = len(endings) + 1
    mass = np.full(tails, 0.5)
    for e, m in masses.items():
        mass[endings.get(e, tails - 1)] += max(m, 0.0)
    layout = recurrent.Layout(edges, tails)
    vocabulary = Vocabulary(
        {w: i for i, (w, _) in enumerate(known)},
        np.array([i if i < len(heads) else 0 for i in range(len(known))], np.int64),
        np.log10(np.array([c for _, c in known], np.float64) + 0.5),
        endings,
        np.log10(mass),
        layout,
        int(total),
        int(distinct),
    )
    for i, (w, _) in enumerate(known[len(heads) :], start=len(heads)):
        vocabulary.symbol[i] = len(heads) + vocabulary.tail_of(w)
    by_symbol = np.concatenate([[c + 0.5 for _, c in heads], mass])
    return vocabulary, by_symbol, lowest


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


def _symbols(v: Vocabulary, codes: _Codes, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(symbols, codes, positions of words outside the dictionary)."""
    found = np.fromiter(map(codes.__getitem__, words), np.int64, len(words))
    symbols = v.symbol[found]
    outside = np.nonzero(found < 0)[0].tolist()
    heads = v.layout.heads
    for i in outside:
        symbols[i] = heads + v.tail_of(words[i])
    return symbols, found, outside


#: Weights that travel as one row.
PIECE = 16_384


def _dealt(v: Vocabulary, deals: int, seed: int):
    """(id, text) -> the group that learns from the document, its place there, its symbols."""
    from xxhash import xxh64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, seen = _Codes(v.codes), Counter()
        for batch in batches:
            places, ids = [], []
            for name, text in zip(batch.column(0), batch.column(1)):
                body = text.as_py()
                own = xxh64_intdigest(f"{name.as_py()}:{xxh64_intdigest(body, seed)}", seed)
                places.append(xxh64_intdigest(f"{own}:{seen[own]}", seed) >> 1)
                seen[own] += 1
                ids.append(_symbols(v, codes, tokens_of(body))[0].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([p % deals for p in places], pa.int64()),
                    pa.array(places, pa.int64()),
                    pa.array(ids, pa.list_(pa.int32())),
                ],
                ["deal", "place", "symbols"],
            )

    return run


def _learned(layout: recurrent.Layout, start: recurrent.Weights, hidden: int, rate: float):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        flat = group.column("symbols").combine_chunks()
        ends = flat.offsets.to_numpy()
        values = flat.values.to_numpy()
        documents = [values[a:b] for a, b in zip(ends[:-1], ends[1:])]
        w = recurrent.Weights(*(a.copy() for a in start.arrays()))
        recurrent.train(w, layout, documents, hidden, rate=rate, seed=key[0].as_py())
        tokens = int(ends[-1] - ends[0])
        whole_set = np.concatenate([a.ravel() for a in w.arrays()]).astype(np.float64) * tokens
        pieces = [whole_set[at : at + PIECE] for at in range(0, len(whole_set), PIECE)]
        n = len(pieces)
        return pa.table(
            {
                "piece": pa.array(range(n), pa.int32()),
                "deal": pa.array([key[0].as_py()] * n, pa.int64()),
                "tokens": pa.array([tokens] * n, pa.int64()),
                "sums": pa.array([p.tobytes() for p in pieces], pa.binary()),
            }
        )

    return run


def _added(key: tuple, group: pa.Table) -> pa.Table:
    """One row for a piece's rows: their sums, always added in the same order."""
    group = group.sort_by("deal")
    sums = sum(np.frombuffer(b.as_py(), np.float64) for b in group.column("sums"))
    return pa.table(
        {
            "piece": pa.array([key[0].as_py()], pa.int32()),
            "deal": pa.array([group.column("deal")[0].as_py()], pa.int64()),
            "tokens": pa.array([sum(group.column("tokens").to_pylist())], pa.int64()),
            "sums": pa.array([sums.tobytes()], pa.binary()),
        }
    )


def learn(training: DataFrame, v: Vocabulary, w: recurrent.Weights, settings: LmSettings) -> recurrent.Weights:
    """Weights after ``passes`` passes over ``training`` (id, text)."""
    deals = max(1, math.ceil(v.total / settings.deal_tokens))
    shape = "piece int, deal long, tokens long, sums binary"
    for turn in range(settings.passes):
        dealt = training.mapInArrow(
            _dealt(v, deals, settings.seed + turn), "deal long, place long, symbols array<int>"
        )
        found = dealt.groupBy("deal").applyInArrow(
            _learned(v.layout, w, settings.hidden, 0.01 / (1 + turn)), shape
        )
        level = found.groupBy("piece", F.pmod("deal", F.lit(64)).alias("some")).applyInArrow(_added, shape)
        rows = sorted(level.groupBy("piece").applyInArrow(_added, shape).collect(), key=lambda r: r["piece"])
        if not rows:
            return w
        mean = np.concatenate([np.frombuffer(r["sums"], np.float64) / r["tokens"] for r in rows])
        arrays, at = [], 0
        for a in w.arrays():
            arrays.append(mean[at : at + a.size].reshape(a.shape).astype(a.dtype))
            at += a.size
        w = recurrent.Weights(*arrays)
    return w


def _scored(v: Vocabulary, w: recurrent.Weights, hidden: int):
    from xxhash import xxh64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes(v.codes)
        heads = v.layout.heads
        each = math.log10(v.total + 0.5 * (v.distinct + 1))
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                documents, rows, size = [], [], 0
                begin = at
                while at < batch.num_rows and size < STEP_TOKENS:
                    words = tokens_of(batch.column(1)[at].as_py())
                    symbols, found, outside = _symbols(v, codes, words)
                    inside = found >= 0
                    counts = v.log_count[found[inside]]
                    tail = symbols >= heads
                    # what a rare word takes of its class; words outside: without their count
                    shares = v.log_count[found[inside & tail]].sum() - v.log_mass[
                        symbols[tail] - heads
                    ].sum()
                    hashes = [xxh64_intdigest(words[i], 42) for i in outside]
                    rows.append(
                        (
                            len(words),
                            int((counts > 0).sum()),
                            float(counts.sum() - each * len(words)),
                            float(shares),
                            np.array(hashes, np.uint64).view(np.int64),
                        )
                    )
                    documents.append(symbols.astype(np.int32))
                    size += len(words)
                    at += 1
                model = recurrent.score_documents(w, v.layout, documents, hidden) / math.log(10)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(begin, at - begin),
                        pa.array([r[0] for r in rows], pa.int64()),
                        pa.array([r[1] for r in rows], pa.int64()),
                        pa.array([r[2] for r in rows], pa.float64()),
                        pa.array([m + r[3] for m, r in zip(model, rows)], pa.float64()),
                        pa.array([r[4] for r in rows], pa.list_(pa.int64())),
                    ],
                    ["row", "n_tokens", "n_known", "base", "model", "rare"],
                )

    return run


def language_scores(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    settings: LmSettings = LmSettings(),
) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``base_score`` is the add-half unigram log10 probability, ``score`` the model's.
    """
    text = whole(F.col(text_col)).cast("binary").alias("text")
    held_out = crc_fold(id_col) == settings.held_out_fold
    training = docs.where(~held_out).select(text)
    counts = cut_lineage(word_counts(training))
    vocabulary, mass, lowest = build_vocabulary(counts, settings)
    weights = recurrent.initial(vocabulary.layout, settings.hidden, mass, settings.seed)
    own = F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id")
    weights = learn(docs.where(~held_out).select(own, text), vocabulary, weights, settings)
    named = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), held_out.alias("held_out"), text
    )
    kind = named.schema["id"].dataType.simpleString()
    scored = cut_lineage(
        named.select(F.struct("row", "id", "held_out").alias("row"), "text").mapInArrow(
            _scored(vocabulary, weights, settings.hidden),
            f"row struct<row:bigint,id:{kind},held_out:boolean>, n_tokens long, n_known long, "
            "base double, model double, rare array<bigint>",
        )
    )
    others = counts if lowest == math.inf else counts.where(_level(F.col("c")) < int(lowest))
    looked_up = (
        scored.select("row", F.explode("rare").alias("h"))
        .join(others.select(F.xxhash64("word").alias("h"), "c"), "h", "left")
        .groupBy("row")
        .agg(
            F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("more"),
            F.count("c").alias("found"),
        )
    )
    zero = F.lit(0).cast("long")
    parts = scored.select(
        "row", "n_tokens", "n_known", "base", "model", F.lit(0.0).alias("more"), zero.alias("found")
    ).unionByName(
        looked_up.select(
            "row",
            zero.alias("n_tokens"),
            zero.alias("n_known"),
            F.lit(0.0).alias("base"),
            F.lit(0.0).alias("model"),
            "more",
            "found",
        )
    )
    return (
        parts.groupBy("row")
        .agg(*(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "model", "more", "found")))
        .select(
            F.col("row.id").alias(id_col),
            F.col("row.held_out").alias("held_out"),
            "n_tokens",
            (F.col("n_known") + F.col("found")).alias("n_known"),
            F.lit(vocabulary.total).cast("long").alias("train_tokens"),
            (
                F.col("base") + F.col("more")
            ).alias("base_score"),
            (F.col("model") + F.col("more")).alias("score"),
        )
    )
