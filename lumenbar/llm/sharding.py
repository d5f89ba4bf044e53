"""Shards of near-equal bytes by histogram sort.

Rows are ordered by a 62-bit key: 36 bits of the text's hash, so that equal texts lie
together, then 26 bits of the id's hash, so that a large group of copies can still be cut.
Exact bytes are counted below candidate key boundaries; the boundaries around a splitter
that is not within tolerance are refined and counted again. When all splitters are placed,
one exchange brings every row to its place.

A coarse boundary never cuts a group of equal texts. Groups are cut only where that is
needed to meet the tolerance.

Defined results: NULL text has no bytes (crc32 of the empty text); every row weighs
``row_bytes`` besides; repeated rows are rows of their own, spread over as many shards as
their bytes need; an empty table gives no rows.
Only id and text are read.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenbar.llm.common import whole, with_copies
from lumenbar.session import cut_lineage

KEY_BITS = 62
#: Key bits known after each round; the first 36 are those of the text.
ROUNDS = (12, 20, 28, 36, 44, 52, 62)


def _key(body: Column, doc_id: Column, turn: Column) -> Column:
    """36 bits of the text's hash above 26 bits of the hash of id and turn."""
    own = F.shiftrightunsigned(F.xxhash64(doc_id.cast("string"), turn), 38)
    return F.shiftleft(F.shiftrightunsigned(body, 28), 26).bitwiseOR(own)


def find_splitters(rows: DataFrame, parts: int, tolerance: float) -> list[int]:
    """Keys that cut ``rows`` (key, size) into ``parts`` of near-equal bytes.

    A round counts bytes per key prefix, summed in the map tasks; from the second round on
    only prefixes that still hold a splitter are read. At most (parts - 1) * 1024 counts
    reach the driver in a round.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    targets = {i: total * i // parts for i in range(1, parts)}
    slack = tolerance * total / parts
    splitters: dict[int, int] = {}
    # prefix -> bytes below it; the whole key space is one prefix of zero bits
    open_prefixes = {0: 0}
    known = 0
    for bits in ROUNDS:
        if not targets or not total:
            break
        here = rows if not known else rows.where(
            F.shiftright("key", KEY_BITS - known).isin(list(open_prefixes))
        )
        counts = (
            here.groupBy(F.shiftright("key", KEY_BITS - bits).alias("prefix"))
            .agg(F.sum("size").alias("size"))
            .collect()
        )
        by_parent: dict[int, list[tuple[int, int]]] = {}
        for r in counts:
            by_parent.setdefault(r["prefix"] >> (bits - known), []).append((r["prefix"], r["size"]))
        edges: list[tuple[int, int, int]] = []  # bytes below, prefix, bytes in it
        for parent, found in by_parent.items():
            below = open_prefixes[parent]
            for prefix, size in sorted(found):
                edges.append((below, prefix, size))
                below += size
        edges.sort()
        starts = [e[0] for e in edges]
        still_open = {}
        for i, target in list(targets.items()):
            below, prefix, size = edges[max(0, bisect_right(starts, target) - 1)]
            low, high = target - below, below + size - target
            if min(low, high) <= slack or bits == KEY_BITS:
                edge = prefix if low <= high else prefix + 1
                splitters[i] = edge << (KEY_BITS - bits)
                del targets[i]
            else:
                still_open[prefix] = below
        open_prefixes, known = still_open, bits
    return [splitters.get(i, 1 << KEY_BITS) for i in range(1, parts)]


def _part_of(key: Column, splitters: list[int]) -> Column:
    """Number of splitters at or below the key, as a balanced tree of comparisons."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key < F.lit(splitters[middle]), tree(low, middle)).otherwise(
            tree(middle + 1, high)
        )

    return tree(0, len(splitters))


def histogram_shards(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = 40,
    parts: int = 8,
    tolerance: float = 0.005,
    row_bytes: int = 16,
) -> DataFrame:
    """One row per document: id, size, text_crc32, shard, slot.

    Each shard is cut into ``parts`` ranges by the same rule, so the final exchange deals
    shards * parts groups and no task orders a whole shard. Slots follow the key order.
    Texts are read once: what the rounds read is a narrow table in the checkpoint folder.
    Rows that repeat id and text arrive there as one row with a count, combined in the map
    tasks, and are written out again from the count.
    """
    text = whole(F.col(text_col))
    distinct = cut_lineage(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + row_bytes).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("body"),
        )
        .groupBy("id", "size", "text_crc32", "body")
        .agg(F.count("*").alias("n"))
    )
    named = F.coalesce(F.col("id").cast("string"), F.lit(""))
    rows = with_copies(distinct, "n", "turn").select(
        "id", "size", "text_crc32", _key(F.col("body"), named, F.col("turn")).alias("key")
    )
    splitters = find_splitters(rows.select("key", "size"), shards * parts, tolerance)
    dealt = rows.withColumn("part", _part_of(F.col("key"), splitters))
    # at most shards * parts rows, a parameter
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"))
    in_shard = Window.partitionBy((F.col("part") / parts).cast("int")).orderBy("part")
    starts = counts.select(
        F.col("part").alias("p"),
        F.coalesce(
            F.sum("n").over(in_shard.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("start"),
    )
    turn = F.row_number().over(Window.partitionBy("part").orderBy("key", "id", "size"))
    return (
        dealt.withColumn("turn", turn)
        .join(F.broadcast(starts), F.col("part") == F.col("p"))
        .select(
            F.col("id").alias(id_col),
            "size",
            "text_crc32",
            (F.col("part") / parts).cast("int").alias("shard"),
            (F.col("start") + F.col("turn") - 1).cast("long").alias("slot"),
        )
    )
