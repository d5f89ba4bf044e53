"""Comparison of two tables by digests of key buckets.

Each side keeps a small table: per bucket of keys a row count and an order-free digest of whole
rows. Two sides are compared bucket by bucket, and full rows are joined in differing buckets
only, so a nightly check of tables that mostly agree reads little besides the digests.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenbar.operators.merge import change_log

BUCKETS = 4096


def row_hash(columns: Sequence[str]) -> Column:
    """64-bit hash of a row that tells NULL from absent and columns from one another."""
    parts = []
    for c in columns:
        parts += [F.col(c).isNull(), F.col(c)]
    return F.xxhash64(*parts)


def bucket_of(keys: Sequence[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(row_hash(keys), F.lit(buckets)).cast("int")


def bucket_digests(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """bucket, n, digest, total: at most ``buckets`` rows, combined in the map tasks.

    Two folds of the row hashes: exclusive or alone would lose pairs of equal rows. ``columns``
    (all by default) are hashed in name order; both sides need the same types.
    """
    names = sorted(columns if columns is not None else df.columns)
    rows = df.select(bucket_of(keys, buckets).alias("bucket"), row_hash(names).alias("_h"))
    return rows.groupBy("bucket").agg(
        F.count("*").alias("n"),
        F.bit_xor("_h").alias("digest"),
        # 31 bits a row: no overflow below four thousand million rows a bucket
        F.sum(F.shiftrightunsigned("_h", 33)).alias("total"),
    )


def differing_buckets(left: DataFrame, right: DataFrame) -> DataFrame:
    """Buckets whose digests differ or that one side lacks: one column ``bucket``."""
    a, b = (
        d.select("bucket", F.struct("n", "digest", "total").alias(name))
        for d, name in ((left, "_a"), (right, "_b"))
    )
    return a.join(b, "bucket", "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).select("bucket")


def rows_of_buckets(
    df: DataFrame, found: DataFrame, keys: Sequence[str], buckets: int = BUCKETS
) -> DataFrame:
    """Rows of ``df`` in those buckets (at most ``buckets`` integers are broadcast)."""
    here = bucket_of(keys, buckets)
    picked = F.broadcast(found.select(F.col("bucket").alias("_bucket")))
    return df.join(picked, here == F.col("_bucket"), "left_semi")


def change_log_by_digest(
    before: DataFrame,
    after: DataFrame,
    keys: Sequence[str],
    digests: tuple[DataFrame, DataFrame] | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """`merge.change_log` of the differing buckets alone, which is the log of all rows.

    ``digests`` are the stored digests of both sides over the columns of ``before``.
    """
    columns = before.columns
    left, right = digests or tuple(bucket_digests(d, keys, columns, buckets) for d in (before, after))
    found = differing_buckets(left, right)
    return change_log(
        *(rows_of_buckets(d.select(*columns), found, keys, buckets) for d in (before, after)), keys
    )


def reconcile_by_digest(
    source: DataFrame,
    target: DataFrame,
    keys: Sequence[str],
    digests: tuple[DataFrame, DataFrame] | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Counts of `audit.reconcile_keys` for two sets of distinct keys, and the buckets joined.

    Totals are sums of the digests; keys are compared in the differing buckets.
    """
    keys = list(keys)
    left, right = digests or tuple(bucket_digests(d, keys, keys, buckets) for d in (source, target))
    found = differing_buckets(left, right)
    s, t = (rows_of_buckets(d.select(*keys), found, keys, buckets) for d in (source, target))
    names = [F.struct(*keys).alias("_k")]
    joined = s.select(*names, F.lit(1).alias("_s")).join(
        t.select(*names, F.lit(1).alias("_t")), "_k", "full"
    )
    # one row each
    sides = [
        left.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("source_keys")),
        right.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("target_keys")),
        joined.agg(
            F.count_if(F.col("_s").isNull()).alias("orphaned_records"),
            F.count_if(F.col("_t").isNull()).alias("missing_records"),
        ),
    ]
    return sides[0].crossJoin(F.broadcast(sides[1])).crossJoin(F.broadcast(sides[2]))
