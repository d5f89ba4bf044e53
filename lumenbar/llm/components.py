"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenbar.session import cut_lineage


def local_forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for nodes that are not the smallest.

    However many links come in, what goes out is at most one row a node.
    """
    nodes, index = np.unique(np.concatenate([left, right]), return_inverse=True)
    u, v = index[: len(left)], index[len(left) :]
    label = np.arange(len(nodes))
    while True:
        a, b = label[u], label[v]
        if (a == b).all():
            break
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while (label != label[label]).any():
            label = label[label]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _star(pairs: DataFrame) -> DataFrame:
    """For each ``a``: the smallest of itself and its ``b``; combined in the map tasks."""
    return pairs.groupBy("a").agg(F.min("b").alias("m")).select(
        "a", F.least("a", "m").alias("m")
    )


def components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (a, b) with b the smallest node of a's component, for a != b.

    Joins are plain equi-joins, so the run-time skew join splits a node with very many
    links. Every round is written to the checkpoint folder. An empty table gives no rows.
    """
    now = cut_lineage(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a <> b")
        .distinct()
    )
    seen = None
    while True:
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if state == seen:
            return now
        seen = state
        both = now.union(now.select("b", "a"))
        large = (
            both.join(_star(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        ).distinct()
        centred = large.join(_star(large), "a")
        small = centred.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            centred.select("a", F.col("m").alias("b"))
        )
        now = cut_lineage(small.where("a <> b").distinct())
