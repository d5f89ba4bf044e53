"""SimHash near-duplicates by anchor-point covering.

Fingerprints (64 bits, or several lanes of 64) link when they differ in few bits. The bits
are cut into blocks so that two linked fingerprints differ in at most one bit of some
block: always, with distance // 2 + 1 blocks; or nearly always, with more and wider blocks
than that would leave for a large distance (``width``). In each block the
anchors are a covering code: a perfect Hamming code on the low bits (covering radius 1),
every word on the remaining bits (radius 0). A fingerprint is at home at the anchor its
block decodes to, and is replicated to every anchor at which a fingerprint one bit away
may be at home, that is, to all anchors within covering radius plus threshold that can be
such a home. Linked fingerprints therefore meet at the home of either, and only homes are
compared with what came to the anchor. Without ``width`` no link is lost.

Equal fingerprints are one fingerprint before anything is compared. An anchor gives a
spanning forest of its links, at most one row for each fingerprint that came. The visits
need not go both ways: of two fingerprints one bit apart each may visit the other's home, so
it is enough that each visits the anchors below its own home (``once``).

Defined results: NULL text is the empty text; texts without words have fingerprint zero
and are linked like any other; repeated rows have the same fingerprint; NULL ids never are
a component's id unless it has no other; an empty table gives no rows. Only id and text
are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenbar.llm.common import free_name, whole
from lumenbar.llm.components import components, local_forest
from lumenbar.session import cut_lineage

SEED = 42
#: Shingles hashed and counted at a time.
STEP = 8192
#: Homes of an anchor that one task holds; beyond it the anchor's homes are dealt to several.
HOMES_PER_TASK = 4096
#: Partners at one anchor that a fingerprint has at most if its pairs are to be listed.
FEW = 2
#: Fingerprint pairs compared at a time.
PAIRS = 1 << 21


def fingerprint(text: bytes, words: int, lanes: int = 1) -> list[int]:
    """SimHash of the word shingles of a text: ``lanes`` signed 64-bit integers.

    Lane n hashes with seed 42 + n.
    """
    from xxhash import xxh64_intdigest

    tokens = text.lower().split()  # of bytes: A-Z only, and the six ASCII spaces only
    if not tokens:
        return [0] * lanes
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    last = ends.tolist()[min(words, len(tokens)) - 1 :]
    out = []
    for lane in range(lanes):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(last), STEP):
            hashes = np.fromiter(
                (
                    xxh64_intdigest(joined[s:e], SEED + lane)
                    for s, e in zip(starts[at : at + STEP], last[at : at + STEP])
                ),
                "<u8",
            )
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
        set_bits = (2 * ones > len(last)).astype(np.uint8)
        out.append(int(np.packbits(set_bits, bitorder="little").view("<i8")[0]))
    return out


def fingerprint_of_set(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """SimHash of a set of 64-bit hashes that is not empty: ``lanes`` signed 64-bit integers.

    Every lane mixes the given hashes anew, so no text is hashed twice.
    """
    turns = np.arange(1, lanes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ones = np.zeros(64 * lanes, np.int64)
    for at in range(0, len(hashes), STEP // 8):
        x = hashes[at : at + STEP // 8, None] + turns
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(factor)
        x ^= x >> np.uint64(31)
        bits = np.unpackbits(x.view(np.uint8), axis=1, bitorder="little")
        # sums of 255 bits fit into a byte
        for row in range(0, len(bits), 255):
            ones += np.add.reduce(bits[row : row + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")


def _lanes(lanes: int) -> list[str]:
    return [f"fp{i}" for i in range(lanes)]


def _fingerprints(words: int, lanes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # one text at a time: the batch itself is all that is held
            found = [fingerprint(t.as_py(), words, lanes) for t in batch.column(1)]
            columns = [pa.array([f[i] for f in found], pa.int64()) for i in range(lanes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", *_lanes(lanes)])

    return run


def fingerprints(
    docs: DataFrame, id_col: str, text_col: str, words: int, lanes: int = 1
) -> DataFrame:
    rows = docs.select(
        F.col(id_col).alias("id"), whole(F.col(text_col)).cast("binary").alias("text")
    )
    kind = rows.schema["id"].dataType.simpleString()
    shape = ", ".join([f"id {kind}", *(f"{c} long" for c in _lanes(lanes))])
    return rows.mapInArrow(_fingerprints(words, lanes), shape)


@dataclass(frozen=True)
class Block:
    """Bits [low, low + code + plain) of a lane: ``code`` of them under a Hamming code."""

    number: int
    lane: int
    low: int
    code: int
    plain: int


def blocks_for(distance: int, lanes: int = 1, width: int | None = None) -> list[Block]:
    """Without ``width``: so many blocks that some block holds at most one of ``distance``
    differing bits (for one lane). With it: as many blocks of that width as there are."""
    if width is None:
        if lanes > 1:
            raise ValueError("several lanes need a block width")
        count = distance // 2 + 1
        edges = [64 * i // count for i in range(count + 1)]
    else:
        edges = list(range(0, 65, width))
    out = []
    for lane in range(lanes):
        for low, high in zip(edges, edges[1:]):
            code = max(n for n in (0, 3, 7, 15) if n <= high - low)
            out.append(Block(len(out), lane, low, code, high - low - code))
    return out


def code_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """For every n-bit word: its codeword, and the codewords of all words one bit away.

    The word's own codeword fills the row where fewer differ.
    """
    words = np.arange(1 << n, dtype=np.int64)
    syndrome = np.zeros_like(words)
    for bit in range(n):
        syndrome ^= np.where(words >> bit & 1, bit + 1, 0)

    def decode(w: np.ndarray, s: np.ndarray) -> np.ndarray:
        return np.where(s > 0, w ^ (1 << np.maximum(s - 1, 0)), w)

    home = decode(words, syndrome)
    away = [decode(words ^ (1 << b), syndrome ^ (b + 1)) for b in range(n)]
    near = np.sort(np.stack(away, axis=1), axis=1) if n else np.zeros((1, 0), np.int64)
    width = n // 2  # besides its own codeword a word has (n - 1) / 2 others that near
    out = np.repeat(home[:, None], max(width, 0), axis=1)
    for w in range(0, 1 << n, 4096):
        rows = near[w : w + 4096]
        own = home[w : w + 4096, None]
        new = (rows != own) & np.concatenate(
            [np.ones((len(rows), 1), bool), rows[:, 1:] != rows[:, :-1]], axis=1
        )[:, : rows.shape[1]]
        place = np.cumsum(new, axis=1) - 1
        r, c = np.nonzero(new)
        out[w + r, place[r, c]] = rows[r, c]
    return home, out


def _anchors(fps: np.ndarray, blocks: list[Block], tables: dict, once: bool) -> Iterator[tuple]:
    """(anchors, rows of ``fps``, role): role 0 at home, role 1 come to be compared.

    With ``once`` the homes are compared among themselves and visited from higher ones only.
    """
    everyone = np.arange(len(fps))
    for b in blocks:
        part = (fps[:, b.lane] >> np.int64(b.low)) & np.int64((1 << (b.code + b.plain)) - 1)
        code, plain = part & ((1 << b.code) - 1), part >> b.code
        home, near = tables[b.code]

        def key(c, p):
            return (np.int64(b.number) << 28) | (p << b.code) | c

        own = home[code]
        yield key(own, plain), everyone, 0
        if not once:
            yield key(own, plain), everyone, 1
        for k in range(near.shape[1]):
            other = near[code, k]
            apart = np.nonzero(other < own if once else other != own)[0]
            yield key(other[apart], plain[apart]), apart, 1
        for bit in range(b.plain):
            at = np.nonzero(plain >> bit & 1)[0] if once else everyone
            yield key(own[at], plain[at] ^ (1 << bit)), at, 1


def _replicate(blocks: list[Block], homes_only: bool, names: list[str], once: bool = False):
    lanes = _lanes(1 + max(b.lane for b in blocks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {b.code: code_tables(b.code) for b in blocks}
        for batch in batches:
            taken = {
                n: batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64)
                for n in batch.schema.names
            }
            fps = np.stack([taken[c] for c in lanes], axis=1)
            columns = [taken[n] for n in names]
            for anchor, at, role in _anchors(fps, blocks, tables, once):
                if homes_only and role:
                    continue
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor),
                        pa.array(np.full(len(at), role, np.int8)),
                        *(pa.array(c[at]) for c in columns),
                    ],
                    ["anchor", "role", *names],
                )

    return run


def _matches(homes: list[np.ndarray], role: np.ndarray, rows: list[np.ndarray], distance: int):
    """Forests of the links between nears and the homes with the same key, both sorted."""
    nears = [c[role == 1] for c in rows]
    low = np.searchsorted(homes[0], nears[0], "left")
    many = np.searchsorted(homes[0], nears[0], "right") - low
    upto = np.cumsum(many)
    at = 0
    while at < len(low):
        before = upto[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(upto, before + PAIRS, "right")))
        count = many[at:stop]
        mine = np.repeat(np.arange(at, stop), count)
        first = np.repeat(low[at:stop] - (upto[at:stop] - count - before), count)
        other = first + np.arange(len(mine))
        apart = np.zeros(len(mine), np.uint16)
        for a, b in zip(nears[2:], homes[2:]):
            apart += np.bitwise_count((a[mine] ^ b[other]).view(np.uint64))
        left, right = nears[1][mine], homes[1][other]
        linked = (apart <= distance) & (left != right)
        if linked.any():
            a, b = local_forest(left[linked], right[linked])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
        at = stop


def _met_before(
    left: list[np.ndarray], right: list[np.ndarray], key: np.ndarray, blocks: list[Block]
) -> np.ndarray:
    """Which pairs meet in a block before that of their key, as the given lanes show."""
    before = np.zeros(len(key), bool)
    lanes = [a ^ b for a, b in zip(left, right)]
    for b in blocks:
        if b.lane < len(lanes):
            part = (lanes[b.lane] >> np.int64(b.low)) & np.int64((1 << (b.code + b.plain)) - 1)
            before |= (key >> 52 > b.number) & (part & (part - 1) == 0)
    return before


def _pairs(distance: int, alike: tuple[int, int], blocks: list[Block]):
    """(a, b, crowd) of what came to an anchor and the homes with the same key, node a above
    b, with another label and few differing bits, if they did not meet in an earlier block:
    up to ``FEW`` of a row as they are; of a row with more, a forest that connects them.

    Rows: role, key, node, label, n and some lanes, sorted by key, role and node; homes by key
    and node. A home meets the homes of smaller nodes, a visitor (role 1) all. Of a pair the
    smaller ``n`` is at least the part ``alike`` of the larger.
    """

    def run(homes: list[np.ndarray], role: np.ndarray, nears: list[np.ndarray]):
        low = np.searchsorted(homes[0], nears[0], "left")
        # homes up to a near's own key and node
        size = len(homes[0])
        order = np.lexsort(
            (
                np.repeat([1, 0], [size, len(low)]),
                np.concatenate([homes[1], nears[1]]),
                np.concatenate([homes[0], nears[0]]),
            )
        )
        upto = np.empty(len(order), np.int64)
        upto[order] = np.cumsum(order < size)
        many = np.where(role == 1, np.searchsorted(homes[0], nears[0], "right"), upto[size:]) - low
        total = np.cumsum(many)
        at = 0
        while at < len(low):
            before = total[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(total, before + PAIRS, "right")))
            count = many[at:stop]
            mine = np.repeat(np.arange(at, stop), count)
            first = np.repeat(low[at:stop] - (total[at:stop] - count - before), count)
            other = first + np.arange(len(mine))
            apart = np.zeros(len(mine), np.uint16)
            for a, b in zip(nears[4:], homes[4:]):
                apart += np.bitwise_count((a[mine] ^ b[other]).view(np.uint64))
            near = np.flatnonzero(apart <= distance)
            mine, other = mine[near], other[near]
            n, m = nears[3][mine], homes[3][other]
            fits = np.minimum(n, m) * alike[1] >= np.maximum(n, m) * alike[0]
            new = np.flatnonzero(fits & (nears[2][mine] != homes[2][other]))
            mine, other = mine[new], other[new]
            lanes = [c[mine] for c in nears[4:]], [c[other] for c in homes[4:]]
            new = ~_met_before(*lanes, nears[0][mine], blocks)
            mine, other = mine[new], other[new]
            crowd = np.bincount(mine - at, minlength=stop - at)[mine - at] > FEW
            a, b = np.maximum(nears[1][mine], homes[1][other]), np.minimum(nears[1][mine], homes[1][other])
            few = np.unique(np.stack([a[~crowd], b[~crowd]]), axis=1)
            for left, right, many_there in ((*few, False), (*local_forest(a[crowd], b[crowd]), True)):
                if len(left):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(left), pa.array(right), pa.array([many_there] * len(left))],
                        ["a", "b", "crowd"],
                    )
            at = stop

    return run


def _compare(found):
    """Rows come sorted by (key, role): an anchor's homes, then what came to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            role, key, *rest = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            rows = [key, *rest]
            homes = [c[role == 0] for c in rows]
            if held is not None:
                homes = [np.concatenate(pair) for pair in zip(held, homes)]
            yield from found(homes, role, rows)
            last = homes[0] == key[-1]  # the last anchor may go on in the next batch
            held = [c[last] for c in homes]

    return run


def _at_anchors(
    source: DataFrame,
    columns: list[str],
    blocks: list[Block],
    homes_per_task: int,
    once: bool = False,
) -> DataFrame:
    """(role, key, ``columns``) of every node at its anchors, each key's rows side by side.

    ``source`` has a node and lanes, and other numbers between or behind them. An anchor with
    very many homes is dealt to several keys: each takes a part of the homes and sees all
    that came to the anchor; with ``once`` also the homes of the other parts, as role 2.
    """
    shape = "anchor long, role byte, " + ", ".join(f"{c} long" for c in columns)
    rows = source.mapInArrow(_replicate(blocks, False, columns, once), shape)
    crowded = cut_lineage(
        source.mapInArrow(_replicate(blocks, True, columns), shape)
        .groupBy("anchor")
        .agg(F.ceil(F.count("*") / homes_per_task).alias("tasks"))
        .where("tasks > 1")
    )
    if crowded.isEmpty():
        dealt = rows.withColumn("key", F.shiftleft("anchor", 24))
    else:
        own = F.pmod(F.xxhash64("node"), F.col("tasks"))
        every = F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)
        task = F.when(F.col("tasks").isNull(), F.array(F.lit(0).cast("long")))
        if not once:
            task = task.when(F.col("role") == 0, F.array(own))
        elsewhere = (F.col("role") == 0) & (F.col("task") != own)
        dealt = (
            rows.join(crowded, "anchor", "left")
            .withColumn("task", F.explode(task.otherwise(every)))
            .withColumn("role", F.when(elsewhere, 2).otherwise(F.col("role")).cast("byte"))
            .withColumn("key", F.shiftleft("anchor", 24) + F.col("task"))
        )
    dealt = dealt.select("role", "key", *columns)
    by = ("key", "role", "node") if once else ("key", "role")
    return dealt.repartition("key").sortWithinPartitions(*by)


def linked_nodes(
    nodes: DataFrame,
    distance: int,
    lanes: int = 1,
    width: int | None = None,
    homes_per_task: int = HOMES_PER_TASK,
) -> DataFrame:
    """(a, b) links that connect the ``nodes`` (node, fp0, ...) within ``distance`` bits."""
    blocks = blocks_for(distance, lanes, width)
    columns = ["node", *_lanes(lanes)]
    rows = _at_anchors(nodes.select(*columns), columns, blocks, homes_per_task)
    return rows.mapInArrow(_compare(partial(_matches, distance=distance)), "a long, b long")


def near_pairs(
    nodes: DataFrame,
    distance: int,
    lanes: int,
    width: int,
    shown: int,
    alike: tuple[int, int],
    homes_per_task: int = HOMES_PER_TASK,
) -> DataFrame:
    """Candidates among ``nodes`` (node, label, n, fp0, ...): the pairs a > b under different
    labels that meet at an anchor of any lane, differ in at most ``distance`` bits of the
    first ``shown`` lanes, which are what travels to the anchors, and have sizes ``n`` of
    which the smaller is at least the part ``alike`` of the larger.

    (a, b, crowd): a pair that is not listed is connected by links marked as ``crowd``. So an
    anchor gives no more rows than ``FEW`` times what came to it, however alike that is.
    """
    blocks = blocks_for(distance, lanes, width)
    columns = ["node", "label", "n", *_lanes(shown)]
    rows = _at_anchors(
        nodes.select("node", "label", "n", *_lanes(lanes)), columns, blocks, homes_per_task, once=True
    )
    found = _compare(_pairs(distance, alike, blocks))
    return rows.mapInArrow(found, "a long, b long, crowd boolean").distinct()


def homes_of(nodes: DataFrame, lanes: int, width: int, columns: list[str]) -> DataFrame:
    """(anchor, ``columns``): every node at its home in each block."""
    shape = "anchor long, role byte, " + ", ".join(f"{c} long" for c in columns)
    blocks = blocks_for(0, lanes, width)
    return nodes.mapInArrow(_replicate(blocks, True, columns), shape).drop("role")


def near_duplicate_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 4,
    distance: int = 4,
    lanes: int = 1,
    width: int | None = None,
) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits a lane), component_id.

    ``component_id`` is the smallest id reachable over links, the row's own included.
    """
    fps = _lanes(lanes)
    rows = cut_lineage(fingerprints(docs, id_col, text_col, words, lanes))
    nodes = cut_lineage(
        rows.groupBy(*fps)
        .agg(F.min("id").alias("first_id"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    roots = components(linked_nodes(nodes, distance, lanes, width))
    rooted = nodes.join(roots.withColumnRenamed("a", "node"), "node", "left").withColumn(
        "root", F.coalesce("b", "node")
    )
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(smallest, "root").select(*fps, "component_id")
    digits = [F.lower(F.lpad(F.hex(c), 16, "0")) for c in fps]
    return rows.join(named, fps).select(
        F.col("id").alias(id_col), F.concat(*digits).alias("fingerprint"), "component_id"
    )


def keep_one(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 4,
    distance: int = 4,
    lanes: int = 1,
    width: int | None = None,
) -> DataFrame:
    """The rows with the smallest id of each near-duplicate group, with all columns.

    A row is known by its id and its text's hash, so rows of different texts that share an
    id are rows of their own; NULL comes before all ids. Rows that repeat id and text stay
    or go together: exact copies are for exact dedup.
    """
    content = F.xxhash64(whole(F.col(text_col)))
    keyed = docs.select(
        F.struct(F.col(id_col).alias("id"), content.alias("h")).alias("key"),
        F.col(text_col).alias("text"),
    )
    groups = near_duplicate_groups(keyed, "key", "text", words, distance, lanes, width)
    h, gone_id, gone_h = (free_name(docs, n) for n in ("h", "gone_id", "gone_h"))
    gone = (
        groups.where(F.col("key") != F.col("component_id"))
        .select(F.col("key.id").alias(gone_id), F.col("key.h").alias(gone_h))
        .distinct()
    )
    same = F.col(id_col).eqNullSafe(F.col(gone_id)) & (F.col(h) == F.col(gone_h))
    return docs.withColumn(h, content).join(gone, same, "left_anti").drop(h)
