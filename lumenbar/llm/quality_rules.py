"""Text quality by a sparse ensemble of rules.

Shallow trees are grown over text statistics; every path from a root to a node is a rule,
a conjunction of thresholds. A lasso logistic regression over the rules keeps a few of
them with weights, and those compile into one Spark column, so scoring is a scan.

Defined results: NULL text is the empty text, all of whose statistics are 0; it is scored
like any other. Without labels, with labels of one kind only, or when no tree finds a split, the score is
the share of positive labels (0.5 without labels). Repeated rows score alike. Only text and id are
read; labels, ids and other columns are no inputs of a score.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenbar.llm.common import UPPER, crc_fold, free_name, lower_ascii, whole, word_count
from lumenbar.llm.labelled import label_sample, labelled
from lumenbar.session import cut_lineage

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#$%&*|<>{}[]~^=+_@/\\"
STATISTICS = (
    "log_chars",
    "log_words",
    "word_length",
    "upper_share",
    "symbol_share",
    "exclamation_share",
    "stop_share",
    "digit_share",
    "non_ascii_share",
    "distinct_words",
    "same_as_last",
    "distinct_lines",
    "line_words",
    "empty",
)


def statistics(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """Adds the statistics of each whole text; returns the frame and their column names.

    Shares are per character or per word. Helper columns stay in the frame under names it
    did not have.
    """
    name = {s: free_name(docs, f"stat_{s}") for s in (*STATISTICS, "words", "lines", "n", "len")}
    text = whole(F.col(text_col))

    def without(chars: str) -> Column:
        return F.length(text) - F.length(F.translate(text, chars, ""))

    parts = docs.withColumns(
        {
            name["words"]: F.filter(
                F.split(lower_ascii(text), SPACES, -1), lambda w: w != ""
            ),
            name["lines"]: F.filter(F.split(text, "\n", -1), lambda w: w != ""),
            name["len"]: F.length(text),
            name["n"]: word_count(text),
        }
    )
    words, lines = F.col(name["words"]), F.col(name["lines"])
    n, length = F.greatest(F.col(name["n"]), F.lit(1)), F.greatest(F.col(name["len"]), F.lit(1))
    pairs = F.zip_with(
        F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
        words,
        lambda a, b: a.eqNullSafe(b),
    )
    found = {
        "log_chars": F.log1p(F.col(name["len"])),
        "log_words": F.log1p(F.col(name["n"])),
        "word_length": F.col(name["len"]) / n,
        "upper_share": without(UPPER) / length,
        "symbol_share": without(SYMBOLS) / length,
        "exclamation_share": without("!?") / n,
        "stop_share": without(".,;:") / n,
        "digit_share": without("0123456789") / length,
        "non_ascii_share": (F.octet_length(text) - F.col(name["len"])) / length,
        "distinct_words": F.size(F.array_distinct(words)) / n,
        "same_as_last": F.size(F.filter(pairs, lambda same: same)) / n,
        "distinct_lines": F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)),
        "line_words": F.log1p(F.col(name["n"]) / F.greatest(F.size(lines), F.lit(1))),
        "empty": (F.col(name["n"]) == 0).cast("double"),
    }
    out = parts.withColumns({name[s]: found[s].cast("double") for s in STATISTICS})
    keep = [*docs.columns, *(name[s] for s in STATISTICS)]
    return out.select(*(F.col(f"`{c}`") for c in keep)), {s: name[s] for s in STATISTICS}


Condition = tuple[str, bool, float]  # statistic, at most (or above), threshold


@dataclass(frozen=True)
class RuleModel:
    """intercept + weights of conjunctive rules, on the logit scale."""

    intercept: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...] = ()

    def score(self, columns: dict[str, str]) -> Column:
        logit = F.lit(self.intercept)
        for rule, weight in self.rules:
            logit = logit + F.when(holds(rule, columns), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def holds(rule: tuple[Condition, ...], columns: dict[str, str]) -> Column:
    out = F.lit(True)
    for statistic, at_most, threshold in rule:
        c = F.col(columns[statistic])
        out = out & ((c <= threshold) if at_most else (c > threshold))
    return out


def tree_paths(printed: str, names: list[str]) -> list[tuple[Condition, ...]]:
    """The conditions on the way to every node of a printed tree."""
    rules, path = [], []
    for line in printed.splitlines():
        m = re.match(r"( +)(If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not m:
            continue
        depth = len(m[1])
        path = [p for p in path if p[0] < depth]
        path.append((depth, (names[int(m[3])], m[4] == "<=", float(m[5]))))
        rules.append(tuple(p[1] for p in path))
    return rules


def train_rules(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    max_rows: int = 20_000,
    trees: int = 15,
    depth: int = 3,
    penalty: float = 0.001,
    seed: int = 11,
) -> RuleModel:
    """Fits rules and weights on at most about ``max_rows`` labelled rows."""
    sample = label_sample(labels, label_col, id_col, max_rows)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    frame, columns = statistics(labelled(own, sample, "id"), "text")
    # the widest the fit ever is: max_rows rows of 15 numbers, in few partitions
    rows = cut_lineage(frame.select("label", *columns.values())).repartition(8).persist()
    try:
        count, mean = rows.agg(F.count("*"), F.avg("label")).first()
        share = min(max(mean if count else 0.5, 1e-6), 1 - 1e-6)
        constant = RuleModel(math.log(share / (1 - share)))
        if not count or mean in (0.0, 1.0):
            return constant
        names = list(STATISTICS)
        vectors = VectorAssembler(inputCols=[columns[s] for s in names], outputCol="features")
        forest = RandomForestClassifier(
            featuresCol="features",
            labelCol="label",
            numTrees=trees,
            maxDepth=depth,
            minInstancesPerNode=3,
            featureSubsetStrategy="0.5",
            seed=seed,
        ).fit(vectors.transform(rows).select("label", "features"))
        rules = list(
            dict.fromkeys(r for t in forest.trees for r in tree_paths(t.toDebugString, names))
        )
        if not rules:
            return constant
        on = rows.select(
            "label",
            *(holds(r, columns).cast("double").alias(f"r{i}") for i, r in enumerate(rules)),
        )
        lasso = LogisticRegression(
            featuresCol="features",
            labelCol="label",
            elasticNetParam=1.0,
            regParam=penalty,
            standardization=False,
            maxIter=60,
        ).fit(
            VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features")
            .transform(on)
            .select("label", "features")
        )
        weights = lasso.coefficients.toArray()
        kept = tuple((r, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-9)
        return RuleModel(float(lasso.intercept), kept)
    finally:
        rows.unpersist()


def score_quality(
    docs: DataFrame,
    model: RuleModel,
    text_col: str = "text",
    score_name: str = "score",
) -> DataFrame:
    """``docs`` with the score of each whole text in ``score_name``."""
    frame, columns = statistics(docs, text_col)
    return frame.select(
        *(F.col(f"`{c}`") for c in docs.columns), model.score(columns).alias(score_name)
    )


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = train_rules(docs, labels)
    own = docs.select("doc_id", "text")
    return score_quality(own, model).select(
        "doc_id",
        (crc_fold() == 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(
    docs: DataFrame, labels: DataFrame, text_col: str = "text", threshold: float = 0.3
) -> DataFrame:
    """The documents that score at least ``threshold``, with all columns."""
    model = train_rules(docs, labels, text_col=text_col)
    score = free_name(docs, "score")
    return score_quality(docs, model, text_col, score).where(F.col(score) >= threshold).drop(score)
