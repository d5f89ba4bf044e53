"""Licence scans by ordered signature rules, without Python workers.

A text becomes its lower-case words (letters, digits and characters beyond ASCII). A rule is
tried only at the words it can start with, and only if its keyword stands among the words
that follow; a text without any such word is not scanned at all. Of overlapping detections
one that lies inside another of a higher level goes, or inside a longer one of its own level;
detections that merely overlap, and equal places of one level, all stay. Base phrases are
reported wherever they stand.

Everything happens in the row: no shuffle, so no key can be hot. Detections are put in order
of their start and folded once with the furthest end of each level, so a text with very many
detections costs its length, not its square.

Defined results: NULL text is the empty text, which has no words and no labels; labels of a
text without any are the empty string; the first and last place are then NULL; the score is
that of the best rule that stays, 0 if none. Every row gives one row; ids are passed on as
they are, NULL and repeated ones included. An empty table gives no rows. Only id and text are
read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenbar.llm.common import UPPER, lower_ascii, whole
from lumenbar.llm.license_rules import LEVELS, RULES, WIDTH, Rule

#: What separates words, in the lower-case text.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _literal(rule: Rule, number: int) -> str:
    return (
        f"named_struct('no', {number}, 'key', '{rule.key} ', 'pattern', '^(?:{rule.pattern}) ', "
        f"'label', '{rule.label}', 'level', {rule.level}, 'score', {rule.score}D, "
        f"'base', {str(rule.base).lower()})"
    )


def rules_by_word(rules: list[Rule]) -> tuple[list[str], Column]:
    """The words rules start with, and a map from each to its rules."""
    words = sorted({a for r in rules for a in r.anchors})
    each = [
        f"'{w}', array({', '.join(_literal(r, i) for i, r in enumerate(rules) if w in r.anchors)})"
        for w in words
    ]
    return words, F.expr(f"map({', '.join(each)})")


def detections(words: Column, rules: list[Rule] = RULES) -> Column:
    """Array of (start, back, rank, no, label, score, base): the matches in order.

    ``back`` is minus the last word, ``rank`` minus the level, so that the natural order puts
    what may contain another detection before it.
    """
    starts, table = rules_by_word(rules)
    starting = F.array(*[F.lit(w) for w in starts])

    def at(i: Column) -> Column:
        window = F.concat(F.array_join(F.slice(words, i + 1, WIDTH), " "), F.lit(" "))
        tried = F.filter(
            F.element_at(table, F.element_at(words, i + 1)),
            lambda r: F.contains(window, r["key"]) & F.rlike(window, r["pattern"]),
        )

        return F.transform(
            tried,
            lambda r: F.struct(
                i.alias("start"),
                (-(i + _spaces(F.regexp_substr(window, r["pattern"])) - 1)).alias("back"),
                (-r["level"]).alias("rank"),
                r["no"].alias("no"),
                r["label"].alias("label"),
                r["score"].alias("score"),
                r["base"].alias("base"),
            ),
        )

    places = F.filter(
        F.sequence(F.lit(0), F.size(words) - 1),
        lambda i: F.array_contains(starting, F.element_at(words, i + 1)),
    )
    return F.array_sort(F.flatten(F.transform(places, at)))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def kept_labels(found: Column) -> Column:
    """(labels, score) of the ordered detections that no other one suppresses."""
    start = F.struct(
        F.array_repeat(F.lit(-1), LEVELS).alias("ends"),
        F.array_repeat(F.lit(-1), LEVELS).alias("froms"),
        F.array().cast("array<string>").alias("labels"),
        F.lit(0.0).alias("score"),
    )

    def step(s: Column, d: Column) -> Column:
        level, end = -d["rank"], -d["back"]
        above = F.array_max(F.slice(s["ends"], level + 1, LEVELS))
        own = F.element_at(s["ends"], level)
        inside = (
            (F.coalesce(above, F.lit(-1)) >= end)
            | (own > end)
            | ((own == end) & (F.element_at(s["froms"], level) < d["start"]))
        )
        further = own < end
        known = F.array_contains(s["labels"], d["label"])
        return F.struct(
            F.transform(
                s["ends"], lambda e, i: F.when((i + 1 == level) & further, end).otherwise(e)
            ).alias("ends"),
            F.transform(
                s["froms"], lambda e, i: F.when((i + 1 == level) & further, d["start"]).otherwise(e)
            ).alias("froms"),
            F.when(inside | known, s["labels"])
            .otherwise(F.concat(s["labels"], F.array(d["label"])))
            .alias("labels"),
            F.when(inside, s["score"]).otherwise(F.greatest(s["score"], d["score"])).alias("score"),
        )

    return F.aggregate(found, start, step)


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def license_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: list[Rule] = RULES,
) -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    starts = F.array(*[F.lit(w) for w in sorted({a for r in rules for a in r.anchors})])
    cut = F.array_remove(F.split(lower_ascii(whole(F.col(text_col))), SEPARATORS), "")
    rows = docs.select(F.col(id_col).alias("id"), cut.alias("words"))
    none = F.expr("array()").cast(
        "array<struct<start:int,back:int,rank:int,no:int,label:string,score:double,base:boolean>>"
    )
    rows = rows.select(
        "id",
        F.size("words").cast("long").alias("n_words"),
        F.when(F.arrays_overlap("words", starts), detections(F.col("words"), rules))
        .otherwise(none)
        .alias("found"),
    )
    rows = rows.select(
        "id",
        "n_words",
        F.filter("found", lambda d: d["base"]).alias("base"),
        F.when(F.size("found") > 0, kept_labels(F.col("found"))).alias("kept"),
    )
    base = F.col("base")
    return rows.select(
        F.col("id").alias(id_col),
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base["start"]).cast("long").alias("first_word"),
        F.array_max(base["start"]).cast("long").alias("last_word"),
        _joined(base["label"]).alias("base_labels"),
        F.when(
            F.col("kept").isNotNull(), _joined(F.array_union(base["label"], F.col("kept.labels")))
        )
        .otherwise("")
        .alias("labels"),
        F.coalesce(F.col("kept.score"), F.lit(0.0)).alias("score"),
    )


def oracle(rules: list[Rule] = RULES) -> str:
    """The same rules, each pair of detections of a text compared."""
    rows = ",\n".join(
        f"({i}, '{a}', '{r.key} ', '^(?:{r.pattern}) ', '{r.label}', {r.level}, {r.score}, {r.base})"
        for i, r in enumerate(rules)
        for a in r.anchors
    )
    return f"""
WITH rules(no, anchor, key, pattern, label, level, score, base) AS (VALUES {rows}),
docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'),
                            '{WORDS}') AS w
  FROM documents),
spots AS (
  SELECT rid, w, unnest(generate_series(1, len(w))) AS i FROM docs),
tried AS (
  SELECT rid, i - 1 AS start, array_to_string(w[i:i + {WIDTH - 1}], ' ') || ' ' AS seen, rules.*
  FROM spots JOIN rules ON anchor = w[i]),
found AS (
  SELECT rid, no, start, label, level, score, base,
         start + length(m) - length(replace(m, ' ', '')) - 1 AS stop
  FROM (SELECT *, regexp_extract(seen, pattern) AS m FROM tried WHERE contains(seen, key))
  WHERE m <> ''),
kept AS (
  SELECT * FROM found d WHERE NOT EXISTS (
    SELECT 1 FROM found e
    WHERE e.rid = d.rid AND e.start <= d.start AND e.stop >= d.stop
      AND (e.level > d.level OR e.level = d.level AND e.stop - e.start > d.stop - d.start))),
base AS (
  SELECT rid, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM found WHERE base GROUP BY rid),
named AS (
  SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT rid, label FROM kept UNION SELECT rid, label FROM found WHERE base) GROUP BY rid),
best AS (SELECT rid, max(score) AS score FROM kept GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word,
       last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM docs LEFT JOIN base USING (rid) LEFT JOIN named USING (rid) LEFT JOIN best USING (rid)
"""
