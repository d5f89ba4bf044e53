"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def whole(text: str | Column) -> Column:
    """The text with NULL read as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z to lower case, every other character as it is.

    `lower` does exactly that for texts of ASCII only and is the cheaper of the two.
    """
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores added until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def crc_fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 5; NULL ids fold as the empty text (remainder 0)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5


def workers_of(df: DataFrame) -> int:
    """How many groups a job deals rows to: the session's shuffle partitions."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


#: Copies that one task makes of a repeated row at most.
COPIES = 10_000


def with_copies(distinct: DataFrame, count: str, turn: str, limit: int = COPIES) -> DataFrame:
    """Every row ``count`` times, numbered 0, 1, ... in ``turn``; ``count`` is dropped.

    For rows that were grouped by all their columns, so that equal rows need no window to be
    told apart. Counts above ``limit`` are cut into runs of that many which are dealt to
    tasks first: however often a row repeats, no task holds all its copies.
    """
    rest = [c for c in distinct.columns if c != count]
    n = F.col(count)
    few = distinct.where(n <= limit).select(
        *rest, F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias(turn)
    )
    runs = F.sequence(F.lit(0).cast("long"), n - 1, F.lit(limit).cast("long"))
    many = (
        distinct.where(n > limit)
        .select(*rest, count, F.explode(runs).alias("first"))
        .repartition(*rest, "first")
        .select(
            *rest,
            F.explode(F.sequence(F.col("first"), F.least(F.col("first") + limit, n) - 1)).alias(turn),
        )
    )
    return few.unionByName(many)
