"""Mixing sources to target weights by capped water-filling.

Each source should give words in proportion to its weight. A source is clamped where its
target would exceed ``max_epochs`` times its own words; what it cannot give is dealt to
the others by weight, until no target is above its cap. Every document is then repeated
whole times, and a seeded order decides which documents get one more, fractional,
repetition: they take it whole until the target is met, the document at the edge in part.

Defined results: NULL text has size 0; NULL is a source of its own and the last one; a
source without words has target 0; an empty table gives no rows. Rows that repeat a
document are documents of their own. Only id, text and source are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenbar.llm.common import WORD, free_name, whole, word_count

#: Hash prefixes (hexadecimal digits) by which a source's documents are ordered in parts.
PREFIX = 3


def cyclic_weights(sizes: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Adds ``weight``: the weights in turn over the sources by code point, NULL last.

    The window runs over one row per source, not over documents.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights)) + 1)
    return sizes.withColumn("weight", turn)


def water_fill(sizes: DataFrame, max_epochs: float) -> DataFrame:
    """Adds ``target`` to rows (source, source_size, weight).

    Clamping goes in the order of cap / weight: a source is clamped when the level, that is
    what is left per unit of weight once all sources before it are clamped, reaches its own
    cap / weight. That is the fixed point of "clamp, deal the excess anew, repeat", found
    with running sums over one row per source.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    order = Window.orderBy(
        F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()
    )
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy()
    level = (
        F.col("all_words") - F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    ) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levelled = sizes.withColumns(
        {
            "all_words": F.sum("source_size").over(everyone).cast("double"),
            "all_weight": F.sum("weight").over(everyone),
        }
    ).withColumns({"level": level, "place": F.row_number().over(order)})
    # the first source that need not be clamped; past it the level means nothing
    fits = F.col("level") * F.col("weight") <= cap
    open_level = F.min_by("level", F.when(fits, F.col("place")))
    return (
        levelled.withColumn("final_level", open_level.over(everyone))
        .withColumn(
            "target",
            F.least(cap, F.coalesce(F.col("final_level") * F.col("weight"), cap)),
        )
        .select("source", "source_size", "weight", "target")
    )


def _seeded(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    max_epochs: float = 3.0,
    seed: int = 17,
    carry: bool = False,
) -> DataFrame:
    """One row per document: id, size, source, source_size, target, repetitions, part, taken.

    ``repetitions`` are whole copies; ``part`` is the number of words of one further copy
    (the whole size, a part at the edge of the source's target, or 0).

    A source is ordered by a seeded hash. Sizes are added up per (source, hash prefix) in
    the map tasks; a running sum over at most 16**PREFIX prefixes a source gives each
    prefix its offset, and only rows of one prefix are ordered together, so a source with
    a third of all rows is spread over thousands of groups. With ``carry`` the whole row
    goes along in ``row`` (used to write the mix).
    """
    extra = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        word_count(whole(F.col(text_col))).alias("size"),
        _seeded(F.col(id_col), seed).alias("order"),
        *extra,
    ).withColumn("prefix", F.substring("order", 1, PREFIX))
    parts = rows.groupBy("source", "prefix").agg(F.sum("size").alias("words"))
    sizes = parts.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = water_fill(cyclic_weights(sizes, weights), max_epochs)
    in_order = Window.partitionBy("source").orderBy("prefix")
    starts = parts.withColumn(
        "start",
        F.coalesce(
            F.sum("words").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ),
    )
    plan = starts.alias("s").join(
        targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))
    ).select(
        F.col("s.source").alias("p_source"),
        F.col("s.prefix").alias("p_prefix"),
        "start",
        "source_size",
        "target",
    )
    within = Window.partitionBy("source", "prefix").orderBy("order", "id", "size").rowsBetween(
        Window.unboundedPreceding, -1
    )
    placed = rows.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0))).join(
        plan,
        F.col("source").eqNullSafe(F.col("p_source")) & (F.col("prefix") == F.col("p_prefix")),
    )
    whole_copies = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0))
    further = F.floor(F.col("target") - whole_copies * F.col("source_size"))
    part = F.greatest(
        F.lit(0), F.least(F.col("size"), further - F.col("start") - F.col("before"))
    )
    return placed.select(
        F.col("id").alias(id_col),
        "size",
        F.col("source").alias(source_col),
        "source_size",
        "target",
        whole_copies.cast("long").alias("repetitions"),
        part.cast("long").alias("part"),
        (whole_copies * F.col("size") + part).cast("long").alias("taken"),
        *(["row"] if carry else []),
    )


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word, white space kept."""
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def write_mix(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as the plan says.

    The copy at the edge of a source's target keeps its first words only. Documents
    without words are in no copy.
    """
    plan = mix(docs, text_col=text_col, carry=True, **options)
    copies = F.col("repetitions") + (F.col("part") > 0).cast("int")
    dealt = plan.where("size > 0").where(copies > 0).withColumn(
        "copy", F.explode(F.sequence(F.lit(1).cast("long"), copies))
    )
    cut = (F.col("copy") > F.col("repetitions")) & (F.col("part") < F.col("size"))
    text = F.col(f"row.`{text_col}`")
    return dealt.select(
        *(
            F.when(cut, first_words(text, F.col("part"))).otherwise(text).alias(c)
            if c == text_col
            else F.col(f"row.`{c}`").alias(c)
            for c in docs.columns
        )
    )


def oracle(weights: tuple[int, ...] = (5, 2, 1), max_epochs: float = 3.0, seed: int = 17) -> str:
    turns = " ".join(f"WHEN {i} THEN {float(w)}" for i, w in enumerate(weights))
    return f"""
WITH d AS (
  SELECT doc_id, source, md5('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS o,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)}
              {turns} END AS weight
  FROM d GROUP BY source),
l AS (
  SELECT *, source_size * {float(max_epochs)}::DOUBLE AS cap,
    ((sum(source_size) OVER ())::DOUBLE
       - coalesce(sum(source_size * {float(max_epochs)}::DOUBLE) OVER w, 0.0))
     / (sum(weight::DOUBLE) OVER () - coalesce(sum(weight::DOUBLE) OVER w, 0.0)) AS level,
    row_number() OVER w AS place
  FROM s WINDOW w AS (ORDER BY source_size / weight::DOUBLE, source NULLS LAST
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT *, least(cap, coalesce(
      (SELECT arg_min(level, place) FROM l WHERE level * weight <= cap) * weight, cap)) AS target
  FROM l),
p AS (
  SELECT d.*, t.source_size, t.target,
         coalesce(floor(t.target / nullif(t.source_size, 0)), 0) AS reps,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id, size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source, source_size, target, reps::BIGINT AS repetitions,
       greatest(0, least(size, floor(target - reps * source_size) - before))::BIGINT AS part,
       (reps * size + greatest(0, least(size, floor(target - reps * source_size) - before)))
         ::BIGINT AS taken
FROM p
"""
