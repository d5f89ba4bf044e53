"""Audit of document filters in every order, from the potential of the removal game.

The game of a part of the table: a coalition S of filters is worth the documents that fail
at least one of them, v(S). Its Hart-Mas-Colell potential is P(empty) = 0 and

    P(S) = (v(S) + sum over i in S of P(S without i)) / |S|

so that the Shapley value of a filter is P(all) - P(all without it). The recursion runs over
the 32 coalitions of five filters in whole numbers (|S|! P(S)); what a filter removes at a
step of an order is v(those before and it) - v(those before).

Documents only meet in aggregates: rows that share text and part combine before and after
each shuffle, so copies of one text, however many, end as one row. 120 orders of five steps
are written out per part from that part's 32 counts.

Defined results: NULL text is the empty text, NULL part the empty string. Words are cut at
ASCII white space, case-sensitive. A row with a NULL id has no smaller id and is nobody's
smaller id; rows that repeat id and text do not make each other duplicates. A document has a
label 1 if any row of ``labels`` of its id says so. An empty table gives no rows. Only the
named columns are read.
"""

from __future__ import annotations

from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenbar.llm.common import UPPER, WORD, whole

LETTERS = "ABCDE"
#: The filter that needs the whole table: a text seen under a smaller id.
REPEATED = "E"
COUNTS = ("n", "good", "toxic")


def text_failures(text: Column) -> Column:
    """Bits of the filters that look at one text: 1 = A, 2 = B, 4 = C, 8 = D."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    # one struct, so that the words are cut once
    sizes = F.transform(
        F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d"))
    )[0]

    def flags(s: Column) -> Column:
        capitals = F.octet_length(text) - F.octet_length(F.translate(text, UPPER, ""))
        few = F.when(s["n"] < 200, 1).otherwise(0)
        dull = F.when(100 * s["d"].cast("long") < 50 * s["n"].cast("long"), 2).otherwise(0)
        loud = F.when(100 * capitals.cast("long") > 3 * F.length(text).cast("long"), 4).otherwise(0)
        marks = F.when(F.octet_length(F.translate(text, "#$%&*|", "")) < F.octet_length(text), 8)
        return few + dull + loud + marks.otherwise(0)

    return F.transform(F.array(sizes), flags)[0]


def failure_counts(
    docs: DataFrame,
    labels: DataFrame,
    part_col: str = "lang",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(part, mask, n, good, toxic): rows of each part by the filters they fail."""
    text = whole(F.col(text_col))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.sha2(text, 256).alias("h"),
        text_failures(text).alias("mask"),
    )
    # Rows of one id, part and text first: they need their labels once.
    each = rows.groupBy("h", "part", "id").agg(F.count("*").alias("n"), F.first("mask").alias("mask"))
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.max((F.col("quality") == 1).cast("long")).alias("good"),
        F.max((F.col("toxic") == 1).cast("long")).alias("toxic"),
    )
    each = each.join(marks, "id", "left").select(
        "h", "part", "id", "mask",
        *[
            (F.col("n") * (F.lit(1) if c == "n" else F.coalesce(c, F.lit(0)))).alias(c)
            for c in COUNTS
        ],
    )
    counts = F.struct(*COUNTS)
    nameless = [F.sum(F.when(F.col("id").isNull(), F.col(c)).otherwise(0)).alias(f"free_{c}") for c in COUNTS]
    texts = each.groupBy("h", "part").agg(
        F.first("mask").alias("mask"),
        *[F.sum(c).alias(c) for c in COUNTS],
        *nameless,
        F.min("id").alias("low"),
        F.min_by(counts, "id").alias("first"),
    )
    # the smallest id of the text over its parts; these are one row a part by now
    lowest = F.min("low").over(Window.partitionBy("h"))
    texts = texts.withColumn("leads", F.col("low") == lowest)
    passing = [
        (F.col(f"free_{c}") + F.when(F.col("leads"), F.col(f"first.{c}")).otherwise(0)).alias(c)
        for c in COUNTS
    ]
    both = texts.select(
        "part",
        F.explode(
            F.array(
                F.struct(F.col("mask").alias("mask"), *passing),
                F.struct(
                    (F.col("mask") + 16).alias("mask"),
                    *[(F.col(c) - p).alias(c) for c, p in zip(COUNTS, passing)],
                ),
            )
        ).alias("x"),
    ).select("part", "x.*")
    return both.where("n > 0").groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in COUNTS])


def worth(counts: Column, size: int) -> Column:
    """v of every coalition, by its bits, from a map of mask -> count."""

    def value(s: Column) -> Column:
        return F.aggregate(
            F.map_entries(counts),
            F.lit(0).cast("long"),
            lambda t, e: t + F.when(e["key"].bitwiseAND(s) != 0, e["value"]).otherwise(0),
        )

    return F.transform(F.sequence(F.lit(0), F.lit((1 << size) - 1)), value)


def potential(v: Column, size: int) -> Column:
    """|S|! P(S) for every coalition by its bits; v is the array of ``worth``.

    In the order of the bits every coalition follows those it contains.
    """
    share = F.array(*[F.lit(factorial(max(bin(s).count("1") - 1, 0))).cast("long") for s in range(1 << size)])

    def step(p: Column, s: Column) -> Column:
        below = [
            F.when(
                s.bitwiseAND(F.lit(1 << i)) != 0,
                F.element_at(p, s.bitwiseAND(F.lit(~(1 << i))) + 1),
            ).otherwise(0)
            for i in range(size)
        ]
        own = F.element_at(share, s + 1) * F.element_at(v, s + 1)
        return F.concat(p, F.array(sum(below, own)))

    return F.aggregate(
        F.sequence(F.lit(1), F.lit((1 << size) - 1)), F.array(F.lit(0).cast("long")), step
    )


def audit(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Counts by failure mask -> one row per part, order and step.

    ``counts`` has part, mask (bit i: fails ``letters[i]``), n, good and toxic. ``shapley``
    is the filter's share times the number of orders, a whole number.
    """
    size = len(letters)
    every = (1 << size) - 1
    maps = [F.map_from_entries(F.collect_list(F.struct("mask", c))).alias(c) for c in COUNTS]
    parts = counts.groupBy("part").agg(F.sum("n").alias("total"), *maps)
    parts = parts.select("part", "total", *[worth(F.col(c), size).alias(f"v_{c}") for c in COUNTS])
    parts = parts.withColumn("p", potential(F.col("v_n"), size))
    # 120 orders of five steps a part
    orders = ",".join("".join(order) for order in permutations(letters))
    bits = F.array(*[F.lit(1 << i) for i in range(size)])

    rows = parts.withColumn("filter_order", F.explode(F.split(F.lit(orders), ",")))
    rows = rows.withColumn(
        "bits",
        F.transform(
            F.sequence(F.lit(1), F.lit(size)),
            lambda k: F.element_at(bits, F.instr(F.lit(letters), F.col("filter_order").substr(k, F.lit(1)))),
        ),
    )
    rows = rows.select("*", F.posexplode("bits").alias("at", "bit"))
    rows = rows.withColumn(
        "before", F.aggregate(F.slice("bits", 1, F.col("at")), F.lit(0), lambda t, b: t + b)
    ).withColumn("step", F.col("at") + 1)
    after = F.col("before") + F.col("bit")

    def at(array: str, s: Column) -> Column:
        return F.element_at(array, s + 1)

    def gone(c: str) -> Column:
        return at(f"v_{c}", after) - at(f"v_{c}", F.col("before"))

    rest = F.lit(every) - F.col("bit")
    removed = gone("n")
    return rows.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - at("v_n", after)).alias("kept"),
        removed.alias("removed"),
        (at("v_n", F.col("bit")) - removed).alias("redundant"),
        (at("v_n", F.lit(every)) - at("v_n", rest)).alias("unique_fails"),
        gone("good").alias("good_lost"),
        gone("toxic").alias("toxic_lost"),
        (at("p", F.lit(every)) - size * at("p", rest)).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """The five filters over whole ``docs``, by part, order and step."""
    return audit(failure_counts(docs, labels, **columns))


def oracle() -> str:
    """Every order counted directly, without coalitions or potentials."""
    tests = " UNION ALL ".join(f"SELECT '{c}' AS f, {1 << i} AS bit" for i, c in enumerate(LETTERS))
    names = [f"f{i}" for i in range(1, 6)]
    apart = " AND ".join(f"{a}.f <> {b}.f" for a, b in combinations(names, 2))
    prior = "\nUNION ALL ".join(
        f"SELECT {' || '.join(f'{n}.f' for n in names)} AS filter_order, {k} AS step, f{k}.bit AS bit, "
        f"{' + '.join(['0'] + [f'f{j}.bit' for j in range(1, k)])} AS before "
        f"FROM {', '.join(f'tests {n}' for n in names)} WHERE {apart}"
        for k in range(1, 6)
    )
    return f"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{WORD}') AS w
  FROM documents),
marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
         max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
masks AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t)
                THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM texts LEFT JOIN marks USING (doc_id)),
counts AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM masks GROUP BY part, mask),
tests AS ({tests}),
steps AS ({prior}),
found AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (before + bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM counts, steps GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM found
"""
