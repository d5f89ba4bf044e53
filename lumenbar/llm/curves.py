"""Approximate nearest neighbours on shifted space-filling curves.

Vectors are rotated onto the principal axes of a bounded sample; the first curves * axes of
them, most telling first, are dealt to the curves, a few axes each. Each group is a Hilbert curve: its axes,
shifted by a seeded offset, become a cell of a grid and the cell becomes a key. Every
curve orders all vectors; equal-count key ranges are the unit of exchange. A query looks
at the key ranges around its own on every curve; each range gives its best candidates,
computed on the original vectors, and the best over all curves and ranges remain.

Vectors that are NULL, zero or of another dimension than most, or that hold NULL or
non-finite components, take no part, neither as query nor as candidate. Rows that repeat
an id are candidates each, also where they repeat the vector; a row never meets its own id. Ties go to the smaller id. Fewer
candidates than asked for give fewer rows; an empty table gives none. Only id and vector
are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CurveSettings:
    """``reach``: share of all vectors that a query sees around itself on each curve.

    Without structure in the data (independent axes) recall is bought with reach alone;
    vectors that vary along few axes need far less. A window holds at least as many rows as
    are asked for. ``ranges`` are key ranges a curve;
    ``block`` is the number of candidates, and of queries, that a task holds at a time.
    """

    curves: int = 8
    axes: int = 4
    bits: int = 10
    ranges: int = 20
    reach: float = 0.2
    fit_rows: int = 5_000
    block: int = 8_192
    seed: int = 3

    def half(self, rows: int, k: int) -> int:
        """Ranges seen to either side of a query's own: the reach, and room for ``k`` others."""
        share = min(1.0, max(self.reach, 2 * (k + 1) / max(rows, 1)))
        return self.ranges if share == 1.0 else max(1, math.ceil(self.ranges * share / 2))


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector can take part."""
    v = F.col(vector)
    odd = F.exists(
        v,
        lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))),
    )
    return rows.where(v.isNotNull() & ~odd & F.exists(v, lambda x: x != 0))


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of points (n, axes) on a grid of 2**bits a side.

    The known transpose form: undo the rotations from the highest bit down, then read the
    Gray code across axes.
    """
    x = cells.astype(np.int64).T.copy()
    axes = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(axes):
            on = (x[i] & q) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


@dataclass(frozen=True)
class Projection:
    """Rotation (dimension x curves * axes), spread of each column, and shift in cells."""

    rotation: np.ndarray
    spread: np.ndarray
    shift: np.ndarray
    settings: CurveSettings

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """(n, curves) keys: three spreads to either side fill the grid."""
        s = self.settings
        side = 1 << s.bits
        place = (vectors @ self.rotation) / (3 * self.spread)
        cells = np.clip((place + 1) / 2 * side * 0.75 + self.shift * side * 0.25, 0, side - 1)
        return np.stack(
            [
                hilbert_keys(cells[:, c * s.axes : (c + 1) * s.axes].astype(np.int64), s.bits)
                for c in range(s.curves)
            ],
            axis=1,
        )


def fit_projection(sample: np.ndarray, settings: CurveSettings) -> Projection:
    """Principal axes of a bounded sample; a curve takes axes spread over their ranks.

    With more curve axes than dimensions the rest are seeded random rotations.
    """
    rng = np.random.default_rng(settings.seed)
    dim = sample.shape[1]
    need = settings.curves * settings.axes
    centred = sample - sample.mean(axis=0)
    _, axes = np.linalg.eigh(centred.T @ centred)
    columns = [axes[:, ::-1]]
    while sum(c.shape[1] for c in columns) < need:
        columns.append(np.linalg.qr(rng.normal(size=(dim, dim)))[0])
    rotation = np.concatenate(columns, axis=1)[:, :need]
    # curve c takes axes c, c + curves, c + 2 * curves, ...: each has one of the widest
    order = [a * settings.curves + c for c in range(settings.curves) for a in range(settings.axes)]
    rotation = rotation[:, order]
    spread = np.maximum((sample @ rotation).std(axis=0), 1e-12)
    return Projection(rotation, spread, rng.random(need), settings)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _keyed(projection: Projection):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = projection.keys(_matrix(batch.column(1)))
            n, curves = keys.shape
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(0, n * curves + 1, curves, dtype=np.int32)),
                        pa.array(keys.reshape(-1)),
                    ),
                ],
                ["id", "keys"],
            )

    return run


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores, ties to the smaller id, in order."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.nonzero(scores >= floor)[0]
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:k]


def _marks(ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What tells rows of one id apart: a hash of the vector's bits, and a number among those
    that repeat the vector too. Repeats lie in the same range and deal of every curve."""
    odd = np.random.default_rng(1).integers(1 << 62, size=vectors.shape[1]).astype(np.uint64) * 2 + 1
    bits = (vectors + 0.0).view(np.uint64)
    marks = ((bits ^ (bits >> np.uint64(29))) * odd).sum(axis=1).view(np.int64)
    turns = np.zeros(len(ids), np.int32)
    if len(np.unique(ids)) < len(ids):
        seen: dict = {}
        for i, row in enumerate(zip(ids.tolist(), marks.tolist())):
            turns[i] = seen[row] = seen.get(row, -1) + 1
    return marks, turns


def _search(k: int, block: int):
    """A (curve, range, deal) group: queries in blocks against candidates in blocks."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        shape = pa.schema(
            [
                ("query_id", pa.int64()),
                ("id", pa.int64()),
                ("score", pa.float64()),
                ("mark", pa.int64()),
                ("turn", pa.int32()),
            ]
        )
        if not left.num_rows or not right.num_rows:
            return shape.empty_table()
        qid = left.column("id").to_numpy().astype(np.int64)
        queries = _matrix(left.column("vector").combine_chunks())
        cid = right.column("id").to_numpy().astype(np.int64)
        vectors = _matrix(right.column("vector").combine_chunks())
        out = ([], [], [], [], [])
        step = max(1, (1 << 22) // max(len(cid), 1))
        for at in range(0, len(qid), step):
            scores = queries[at : at + step] @ vectors.T
            for i, row in enumerate(scores):
                q = qid[at + i]
                row[cid == q] = -np.inf
                top = best_of(row, cid, k)
                top = top[row[top] > -np.inf]
                exact = np.einsum("ij,j->i", vectors[top], queries[at + i])
                out[0].append(np.full(len(top), q))
                out[1].append(cid[top])
                out[2].append(exact)
                marks, turns = _marks(cid[top], vectors[top])
                out[3].append(marks)
                out[4].append(turns)
        return pa.table([np.concatenate(c) for c in out], names=shape.names).cast(shape)

    return run


def nearest(
    rows: DataFrame,
    queries: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    settings: CurveSettings = CurveSettings(),
) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` best candidates found for each query row.

    Ranges are cut at approximate key quantiles, and
    rows whose equal keys span several ranges are dealt to them by hash, so ranges stay
    even under copies; beyond ``block`` rows a range's candidates, and its queries, are
    dealt to several tasks by hash, and every deal of one meets every deal of the other.
    Keys are computed again where rows are dealt, which is cheaper than keeping them. Work
    is queries x reach x rows on each curve: a stated query set in blocks.
    """
    base = usable(
        rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")), "vector"
    ).where("id is not null")
    asked = usable(
        queries.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")), "vector"
    ).where("id is not null")
    sizes = base.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(
        F.desc("n"), "dim"
    ).head(1)
    empty = "query_id long, rank int, id long, score double"
    if not sizes:
        return rows.sparkSession.createDataFrame([], empty).withColumnRenamed("id", id_col)
    dim, total = sizes[0]["dim"], sizes[0]["n"]
    base, asked = (d.where(F.size("vector") == dim) for d in (base, asked))
    share = min(1.0, settings.fit_rows / total)
    picked = F.pmod(F.xxhash64("id", F.lit(settings.seed)), F.lit(1_000_003)) / 1_000_003
    sample = base.where(picked <= share).limit(2 * settings.fit_rows).select("vector").toPandas()
    fitted = np.stack([np.asarray(v, np.float64) for v in sample["vector"]]) if len(sample) else np.eye(dim)
    projection = fit_projection(fitted, settings)
    shape = "id long, keys array<long>"
    own = base.select(F.col("id").cast("long").alias("id"), "vector")
    ask = asked.select(F.col("id").cast("long").alias("id"), "vector")
    keys = own.mapInArrow(_keyed(projection), shape)
    fractions = [i / settings.ranges for i in range(1, settings.ranges)]
    edges = keys.agg(
        *(
            F.percentile_approx(F.col("keys")[c], fractions, 10_000).alias(f"c{c}")
            for c in range(settings.curves)
        )
    ).first()
    spans = [np.array(e, np.int64) for e in edges]
    half = settings.half(total, k)
    window = min(settings.ranges, 2 * half + 1)
    deals = (
        max(1, math.ceil(total / settings.ranges / settings.block)),
        max(1, math.ceil(ask.count() * window / settings.ranges / settings.block)),
    )
    kind = own.schema["vector"].dataType.simpleString()

    def placed(frame: DataFrame, asks: bool) -> DataFrame:
        return frame.mapInArrow(
            _placed(projection, spans, half, deals, asks),
            f"curve int, range int, deal int, q_deal int, id long, vector {kind}",
        )

    group = ["curve", "range", "deal", "q_deal"]
    found = (
        placed(ask, True)
        .groupBy(*group)
        .cogroup(placed(own, False).groupBy(*group))
        .applyInArrow(_search(k, settings.block), "query_id long, id long, score double, mark long, turn int")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (
        found.dropDuplicates(["query_id", "id", "mark", "turn"])
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias(id_col), "score")
    )


def _placed(
    projection: Projection,
    spans: list[np.ndarray],
    half: int,
    deals: tuple[int, int],
    asks: bool,
):
    """Rows with the ranges they belong to, or, for queries, the ranges they look at."""
    settings = projection.settings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            mixed = mixed.astype(np.int64)
            vectors = batch.column(1)
            keys = projection.keys(_matrix(vectors))
            for c, edge in enumerate(spans):
                low = np.searchsorted(edge, keys[:, c], "left")
                high = np.searchsorted(edge, keys[:, c], "right")
                if asks:
                    # a window of 2 * half + 1 ranges, moved inwards at the curve's ends
                    first = np.clip(low - half, 0, max(0, settings.ranges - 2 * half - 1))
                    last = np.clip(np.maximum(high + half, first + 2 * half), 0, settings.ranges - 1)
                    repeat = deals[0]
                else:
                    first = last = low + mixed % (high - low + 1)
                    repeat = deals[1]
                count = (last - first + 1) * repeat
                row = np.repeat(np.arange(len(ids)), count)
                turn = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                where, other = first[row] + turn // repeat, turn % repeat
                own = (mixed // 64)[row] % deals[int(asks)]
                deal, q_deal = (other, own) if asks else (own, other)
                for at in range(0, len(row), 4096):
                    some = slice(at, at + 4096)
                    small = [np.full(len(row[some]), c), where[some], deal[some], q_deal[some]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(pa.array(x.astype(np.int32)) for x in small),
                            pa.array(ids[row[some]]),
                            vectors.take(pa.array(row[some])),
                        ],
                        ["curve", "range", "deal", "q_deal", "id", "vector"],
                    )

    return run
