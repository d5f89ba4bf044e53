"""Exact duplicates by a 128-bit content hash, bytes compared inside every hash group.

Defined results: NULL text equals the empty text. Of equal texts one row stays, the one
with the largest (or smallest) id; NULL ids come last in either order; of rows that repeat
the id as well, one stays. An empty table gives no rows. Only the id and text columns
are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenbar.llm.common import free_name, lower_ascii, whole, with_copies
from lumenbar.session import cut_lineage

Digest = Callable[[Column], Column]


def md5_bytes(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _groups(rows: DataFrame, keys: list[str], keep: str) -> DataFrame:
    """Per key: the id that stays, the row count, and whether all bytes are equal.

    min(text) = max(text) compares the bytes of every row of a group without bringing the
    rows together: both combine in the map tasks, so a hot group arrives as one row a task.
    """
    best = F.max("id") if keep == "max" else F.min("id")
    return rows.groupBy(*keys).agg(
        best.alias("keep_id"),
        F.count("*").alias("group_size"),
        (F.min("norm") == F.max("norm")).alias("same"),
    )


def duplicate_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "max",
    digest: Digest = md5_bytes,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Rows are grouped by ``digest``; a group whose bytes differ (a collision) is grouped
    again by digest and text. Rows that repeat id and text become one row with a count, in
    the map tasks, and are told apart by their number when they are written out again: no
    window orders a group. Nothing behind the join asks for its partitioning, so the run-time
    skew join may split the rows of a hot text. The joins move ids and hashes only.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), lower_ascii(whole(F.col(text_col))).alias("norm")
    ).withColumn("h", digest(F.col("norm")))
    groups = cut_lineage(_groups(rows, ["h"], keep))
    light = ["id", "h", "sha"]
    counted = cut_lineage(
        rows.select("id", "h", F.unhex(F.sha2("norm", 256)).alias("sha"))
        .groupBy(*light)
        .agg(F.count("*").alias("n"))
    )
    clashes = groups.where(~F.col("same")).select("h")
    found = counted.join(groups.where("same").drop("same"), "h")
    if not clashes.isEmpty():
        # texts of one digest differ: the counted rows meet their own text's group by its hash
        apart = rows.join(clashes, "h", "left_semi")
        parts = _groups(apart, ["h", "norm"], keep).select(
            "h", F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size"
        )
        found = found.unionByName(counted.join(parts, ["h", "sha"]))
    each = with_copies(found, "n", "turn")
    return each.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("turn") == 0)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "max",
    digest: Digest = md5_bytes,
) -> DataFrame:
    """The rows that stay, with all columns of ``docs``.

    One aggregation carries the best row of each hash group beside the smallest and the
    largest text; only groups with differing bytes are grouped again by the text itself.
    """
    row, norm, h = (free_name(docs, n) for n in ("row", "norm", "h"))
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(row),
        lower_ascii(whole(F.col(text_col))).alias(norm),
    ).withColumn(h, digest(F.col(norm)))
    # NULL ids lose against any id; max_by skips rows whose ordering is NULL, a struct is not
    at = F.col(f"{row}.`{id_col}`")
    order = F.struct(at.isNotNull(), at if keep == "max" else -at)
    best = F.max_by(row, order).alias("best")
    groups = cut_lineage(
        rows.groupBy(h).agg(best, (F.min(norm) == F.max(norm)).alias("same"))
    )
    clashes = groups.where(~F.col("same")).select(h)
    found = groups.where("same").select("best.*")
    if not clashes.isEmpty():
        apart = rows.join(clashes, h, "left_semi")
        found = found.unionByName(apart.groupBy(h, norm).agg(best).select("best.*"))
    return found


ORACLE = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                           'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM n
"""
