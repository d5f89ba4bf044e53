"""Near duplicates by anchor SimHash and exact similarity of word shingles.

Two texts link when they share at least ``alike`` (4 / 5) of their five-word shingles
(Jaccard). Candidates come from the anchor search of ``simhash``: a text has a fingerprint of
eight lanes of 64 bits over its distinct shingles, each lane is cut into four blocks of a
Hamming code, and a text goes to its home anchor and to all anchors at which a fingerprint
one bit away in the block is at home. Texts of similarity 0.8 differ in 15.2 % of the bits at
most on average, so they differ in at most one bit of a block with a chance of 0.31, and in none of the
32 blocks with one of seven in a million (of fewer than about 20 shingles: nine in ten
thousand at worst, since one shingle more tips more bits). What meets and differs in at most
``APART`` of 128 bits is confirmed on the whole shingle sets.

In two turns each text meets the nearest of the hubs of its home anchors first, and confirmed
links join texts under one label. Then all texts under different labels that meet at an anchor
are compared, within the task that holds the anchor or a part of it. Pairs are confirmed in
cells: texts are dealt to parts, and a cell holds the pairs between two parts and the sets of
their texts once, however many pairs they have. A text that has several candidates at an
anchor, such as one of many texts a little below 0.8, is not listed with each of them: such
texts leave the anchors as crowds, and all pairs of a crowd are compared in its cells, which
only links leave, fewer than a cell has texts. Pairs that an anchor lists are compared by whole
fingerprints first: those inside a crowd are not confirmed twice, those too far apart not at
all. Rows thus grow with the texts, comparisons with the square of a crowd. What
is stored between the steps is compressed and deleted at the end. Links, which are few, are
checkpoints, so that the shuffle files behind them are deleted when they are found.

Defined results: shingles are those of the lower-cased (A-Z) text cut at ASCII white space,
a text of fewer words is one shingle; NULL text is the empty text, and empty texts are
alike; NULL ids come before all others; an empty table gives no rows. Shingles are known by
64-bit hashes. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenbar.llm import simhash
from lumenbar.llm.common import free_name, whole
from lumenbar.llm.components import components
from lumenbar.session import Scratch, cut_lineage, scratch, shuffles_deleted, stored

SEED = 42
#: Lanes of 64 bits of a fingerprint, and bits of a block (all under the Hamming code).
LANES, WIDTH = 8, 15
#: Of the first SHOWN lanes a candidate pair differs in APART bits at most: at 0.8 more differ
#: with a chance of one in a million, of unlike texts so few with one of one in 100,000.
SHOWN, APART = 2, 40
#: Bits of all lanes in which texts of a crowd that are linked differ at most: 6 deviations
#: from what is expected at 0.8, 3.6 for texts of 4 and 5 shingles. Pairs that anchors list differ
#: in no more either, but for texts of fewer than SHORT shingles, which are always confirmed.
FAR, SHORT = 128, 20
#: Turns of comparing with hubs, texts that are compared in one task, and shingles of the
#: texts of a cell's part (12 MB; one text may have more).
TURNS, BLOCK, CELL = 2, 4096, 1_500_000
FP = [f"fp{i}" for i in range(LANES)]


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    from xxhash import xxh64_intdigest

    tokens = text.lower().split()
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens] or [1]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    last = ends.tolist()[min(words, max(len(tokens), 1)) - 1 :]
    hashes = (xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, last))
    return np.unique(np.fromiter(hashes, np.uint64, len(last)))


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes = [], []
            for text in batch.column(1):
                hashes = shingles(text.as_py(), words)
                sizes.append(len(hashes))
                found.append(simhash.fingerprint_of_set(hashes, LANES))
            lanes = np.stack(found).T if found else np.zeros((LANES, 0), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    *(pa.array(np.ascontiguousarray(lane)) for lane in lanes),
                ],
                ["key", "n", *FP],
            )

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                hashes = shingles(batch.column(1)[at].as_py(), words).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, 1), pa.array([hashes], pa.list_(pa.int64()))],
                    ["node", "shingles"],
                )

    return run


def _held(sets: pa.Table) -> dict[int, np.ndarray]:
    """The shingle sets of a cell by node."""
    flat = sets.column("shingles").combine_chunks()
    ends = flat.offsets.to_numpy()
    values = flat.values.to_numpy().view(np.uint64)
    return {n: values[s:e] for n, s, e in zip(sets.column("node").to_pylist(), ends, ends[1:])}


def _linked(own: np.ndarray, others: list[np.ndarray], alike: tuple[int, int]) -> np.ndarray:
    """Which of the other sets are similar enough to a text's own."""
    n, sizes = len(own), np.array([len(o) for o in others], np.int64)
    enough = np.minimum(sizes, n) * alike[1] >= np.maximum(sizes, n) * alike[0]
    for at in np.flatnonzero(enough).tolist():
        place = np.minimum(np.searchsorted(own, others[at]), n - 1)
        shared = int((own[place] == others[at]).sum())
        # shared / (both - shared) >= p / q, in whole numbers
        enough[at] = shared * (alike[0] + alike[1]) >= (n + sizes[at]) * alike[0]
    return enough


def _checked(alike: tuple[int, int]):
    """The pairs of one cell whose whole shingle sets are similar enough."""

    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        held = _held(sets)
        a, b = (pairs.column(c).to_numpy() for c in ("a", "b"))
        enough = np.zeros(len(a), bool)
        order = np.argsort(a, kind="stable")
        cuts = np.flatnonzero(np.diff(a[order])) + 1
        for rows in np.split(order, cuts) if len(a) else []:
            enough[rows] = _linked(held[int(a[rows[0]])], [held[x] for x in b[rows].tolist()], alike)
        return pa.table({"a": a[enough], "b": b[enough]})

    return run


def _all_checked(alike: tuple[int, int]):
    """Links that connect what is similar in one cell of a crowd: between two of its parts, or
    inside one. Texts that are connected by links found before are not confirmed again."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("own", "ascending"), ("node", "ascending")])
        node, label, own = (rows.column(c).to_numpy() for c in ("node", "label", "own"))
        label = label.copy()
        fps = np.stack([rows.column(c).to_numpy() for c in FP], axis=1)
        held = _held(rows)
        first = int(np.searchsorted(own, key[1].as_py(), "right"))
        out: list[np.ndarray] = [np.zeros((2, 0), np.int64)]
        for u in range(first if key[1] != key[2] else len(own) - 1):
            start = first if key[1] != key[2] else u + 1
            apart = np.bitwise_count((fps[start:] ^ fps[u]).view(np.uint64)).sum(axis=1, dtype=np.int64)
            at = start + np.flatnonzero((label[start:] != label[u]) & (apart <= FAR))
            if len(at):
                at = at[_linked(held[int(node[u])], [held[x] for x in node[at].tolist()], alike)]
                joined, first_of = np.unique(label[at], return_index=True)
                at = at[first_of]
                label[np.isin(label, joined)] = label[u]
                out.append(np.stack([np.maximum(node[at], node[u]), np.minimum(node[at], node[u])]))
        a, b = np.concatenate(out, axis=1)
        return pa.table({"a": a, "b": b})

    return run


class _Texts:
    """The documents as (key, text), and their nodes; gives the shingle sets of some nodes."""

    def __init__(self, keyed: DataFrame, nodes: DataFrame, words: int, held: Scratch) -> None:
        self.keyed, self.nodes, self.words, self.held = keyed, nodes, words, held

    def sets(self, wanted: DataFrame) -> DataFrame:
        """(node, shingles) of the wanted nodes, once each."""
        named = wanted.join(self.nodes, "node").select(
            "node", F.col("key.id").alias("id"), F.col("key.h").alias("h")
        )
        same = F.col("key.id").eqNullSafe(F.col("id")) & (F.col("key.h") == F.col("h"))
        return (
            self.keyed.join(named, same)
            .groupBy("node")
            .agg(F.first("text").alias("text"))
            .mapInArrow(_sets(self.words), "node long, shingles array<long>")
        )

    def confirmed(self, candidates: DataFrame, alike: tuple[int, int]) -> DataFrame:
        """The candidates (a, b) whose whole shingle sets are similar enough."""
        pairs = self.held.store(candidates)
        wanted = self.held.store(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        n = wanted.join(self.nodes, "node").agg(F.sum("n")).first()[0] or 0
        parts = F.lit(max(1, -(-n // CELL)))
        dealt = pairs.select(
            F.pmod(F.xxhash64("a"), parts).alias("i"), F.pmod(F.xxhash64("b"), parts).alias("j"), "a", "b"
        )
        sent = dealt.select(
            F.col("i").alias("to_i"), F.col("j").alias("to_j"), F.explode(F.array("a", "b")).alias("node")
        ).distinct()
        beside = sent.join(self.sets(wanted), "node")
        found = dealt.groupBy("i", "j").cogroup(beside.groupBy("to_i", "to_j"))
        return cut_lineage(found.applyInArrow(_checked(alike), "a long, b long"))

    def members(self, links: DataFrame) -> DataFrame:
        """(node, crowd) of the texts of each connected crowd."""
        roots = components(links)
        members = roots.select(F.col("a").alias("node"), F.col("b").alias("crowd"))
        return self.held.store(members.union(roots.select("b", "b").distinct()))

    def crowds(self, crowds: DataFrame, rows: DataFrame, alike: tuple[int, int]) -> DataFrame:
        """The links (a, b) between texts under different labels of each crowd (node, crowd)."""
        parts_of = F.greatest(F.ceil(F.sum("n") / CELL), F.ceil(F.count("*") / BLOCK))
        sizes = crowds.join(self.nodes.select("node", "n"), "node")
        parts = sizes.groupBy("crowd").agg(parts_of.cast("int").alias("parts"))
        own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
        dealt = crowds.join(parts, "crowd").withColumn("own", own).join(rows, "node")
        dealt = dealt.join(self.sets(crowds.select("node")), "node")
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        cells = {"i": F.least("own", "other"), "j": F.greatest("own", "other")}
        dealt = dealt.withColumns(cells).drop("parts", "other").groupBy("crowd", "i", "j")
        return cut_lineage(dealt.applyInArrow(_all_checked(alike), "a long, b long"))


def _beside_crowds(pairs: DataFrame, rows: DataFrame, crowds: DataFrame) -> DataFrame:
    """The pairs (a, b) that are left to confirm: of two texts with more than ``FAR`` differing
    bits only short ones may be similar enough, and a crowd (node, crowd) compares its own."""
    named = rows.select("node", "n", *FP).join(crowds, "node", "left")
    for end in ("a", "b"):
        columns = (F.col(c).alias(f"{c}_{end}") for c in ("n", "crowd", *FP))
        # all fingerprints: not to be sent through the driver
        pairs = pairs.join(named.select(F.col("node").alias(end), *columns).hint("merge"), end)
    apart = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in FP), F.lit(0))
    compared = F.coalesce(F.col("crowd_a") == F.col("crowd_b"), F.lit(False))
    left = F.when(apart <= FAR, ~compared).otherwise(F.least("n_a", "n_b") < SHORT)
    return pairs.where(left).select("a", "b")


def _labelled(nodes: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(node, label, fp0, ...): the label is the smallest node that a node is linked to so far."""
    if roots is None:
        return nodes.select("node", F.col("node").alias("label"), "n", *FP)
    found = nodes.join(roots.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left")
    return found.select("node", F.coalesce("root", "node").alias("label"), "n", *FP)


def _with_hubs(rows: DataFrame, turn: int, alike: tuple[int, int]) -> DataFrame:
    """(a, b) of each text and the nearest hub of its home anchors, if few bits and sizes differ.

    Texts that are joined so meet no more; all others do behind the turns. The hub is one text
    of an anchor, another one each turn. There are 65,536 anchors that texts may be at home at,
    however many texts there are, so their hubs go to all tasks.
    """
    shown = FP[:SHOWN]
    homes = simhash.homes_of(rows, LANES, WIDTH, ["node", "label", "n", *shown])
    hub = F.struct(F.xxhash64("node", F.lit(turn)).alias("order"), "node", "label", "n", *shown)
    hubs = homes.groupBy("anchor").agg(F.min(hub).alias("hub"))
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"hub.{c}"))) for c in shown), F.lit(0))
    n, m = F.col("n"), F.col("hub.n")
    near = (apart <= APART) & (F.least(n, m) * alike[1] >= F.greatest(n, m) * alike[0])
    beside = homes.join(F.broadcast(hubs), "anchor").where(
        near & (F.col("label") != F.col("hub.label"))
    )
    nearest = beside.groupBy("node").agg(F.min(F.struct(apart, "hub.node")).alias("to"))
    return nearest.select(
        F.greatest("node", "to.node").alias("a"), F.least("node", "to.node").alias("b")
    ).distinct()


def roots_of(nodes: DataFrame, texts: _Texts, alike: tuple[int, int]) -> DataFrame:
    """(a, b): b the smallest node linked with a, for nodes (node, fp0, ...)."""
    links, roots = None, None
    for turn in range(TURNS + 1):
        rows = _labelled(nodes, roots)
        if turn < TURNS:
            found = texts.confirmed(_with_hubs(rows, turn, alike), alike)
        else:
            near = cut_lineage(simhash.near_pairs(rows, APART, LANES, WIDTH, SHOWN, alike, BLOCK))
            crowds = texts.members(near.where("crowd").select("a", "b"))
            few = _beside_crowds(near.where("not crowd").select("a", "b"), rows, crowds)
            found = texts.confirmed(few, alike)
            found = found.union(texts.crowds(crowds, rows, alike))
        links = found if links is None else links.union(found)
        roots = components(links)
    return roots


def keep_one(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    alike: tuple[int, int] = (4, 5),
) -> DataFrame:
    """The rows with the smallest id of each group of linked texts, with all columns.

    A row is known by its id and its text's hash, so rows of different texts that share an
    id are rows of their own. Rows that repeat id and text stay or go together: exact copies
    are for exact dedup.
    """
    content = F.xxhash64(whole(F.col(text_col)))
    keyed = docs.select(
        F.struct(F.col(id_col).alias("id"), content.alias("h")).alias("key"),
        whole(F.col(text_col)).cast("binary").alias("text"),
    )
    kind = keyed.schema["key"].dataType.simpleString()
    with scratch(docs.sparkSession) as held, shuffles_deleted(docs.sparkSession):
        lanes = ", ".join(f"{c} long" for c in FP)
        nodes = held.store(
            keyed.mapInArrow(_fingerprints(words), f"key {kind}, n long, {lanes}")
            .groupBy("key")
            .agg(*[F.first(c).alias(c) for c in ("n", *FP)])
            .withColumn("node", F.monotonically_increasing_id())
        )
        roots = roots_of(nodes, _Texts(keyed, nodes.select("node", "key", "n"), words, held), alike)
        rooted = nodes.select("node", "key").join(
            roots.withColumnRenamed("a", "node"), "node", "left"
        )
        rooted = stored(rooted.select("key", F.coalesce("b", "node").alias("root")))
    first = rooted.groupBy("root").agg(F.min("key").alias("first"))
    h, gone_id, gone_h = (free_name(docs, n) for n in ("h", "gone_id", "gone_h"))
    gone = (
        rooted.join(first, "root")
        .where("key <> first")
        .select(F.col("key.id").alias(gone_id), F.col("key.h").alias(gone_h))
    )
    match = F.col(id_col).eqNullSafe(F.col(gone_id)) & (F.col(h) == F.col(gone_h))
    return docs.withColumn(h, content).join(gone, match, "left_anti").drop(h)
