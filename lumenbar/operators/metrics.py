"""Binary-classification metrics per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins of a probability, and parts of each bin.
PROB_BINS = 65536


def roc_auc(
    df: DataFrame, keys: Sequence[str] = (), label: str = "target", prob: str = "prob"
) -> DataFrame:
    """Exact tie-aware ROC-AUC per key; NULL when a key has one class.

    Rows merge into distinct probabilities in the map tasks. Ranks are built inside parts of
    bins, parts are added up inside bins and bins along the key, so no window spans a whole
    key, however closely calibrated probabilities crowd: a part is 2^-32 wide, and the two
    windows above it see at most 65,536 rows.
    """
    keys = list(keys)
    distinct = (
        df.groupBy(*keys, F.col(prob).alias("_p"))
        .agg(F.sum(F.col(label).cast("long")).alias("_pos"), F.count(label).alias("_n"))
        .withColumns({"_neg": F.col("_n") - F.col("_pos"), "_part": F.floor(F.col("_p") * PROB_BINS * PROB_BINS)})
        .withColumn("_bin", F.floor(F.col("_part") / PROB_BINS))
    )
    in_part = Window.partitionBy(*keys, "_bin", "_part").orderBy("_p")
    below = F.sum("_neg").over(in_part) - F.col("_neg")
    parts = (
        distinct.withColumn("_won", F.col("_pos").cast("double") * (below + F.col("_neg") / 2))
        .groupBy(*keys, "_bin", "_part")
        .agg(F.sum("_won").alias("_won"), F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg"))
    )

    def with_lower(df: DataFrame, along) -> DataFrame:
        lower = F.sum("_neg").over(along) - F.col("_neg")
        return df.withColumn("_won", F.col("_won") + F.col("_pos").cast("double") * lower)

    bins = (
        with_lower(parts, Window.partitionBy(*keys, "_bin").orderBy("_part"))
        .groupBy(*keys, "_bin")
        .agg(F.sum("_won").alias("_won"), F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg"))
    )
    return (
        with_lower(bins, Window.partitionBy(*keys).orderBy("_bin"))
        .groupBy(*keys)
        .agg(
            F.try_divide(
                F.sum("_won"), F.sum("_pos").cast("double") * F.sum("_neg").cast("double")
            ).alias("roc_auc")
        )
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def classification_metrics(
    df: DataFrame,
    keys: Sequence[str] = (),
    label: str = "target",
    prob: str = "prob",
    threshold: float = 0.5,
) -> DataFrame:
    """Rows, accuracy, precision, recall, F1 (0 when undefined), Brier score and ROC-AUC."""
    keys = list(keys)
    y, p = F.col(label), F.col(prob)
    hit = (p >= threshold).cast("int")
    base = df.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        F.avg((hit == y).cast("double")).alias("accuracy"),
        F.sum(hit * y).alias("_tp"),
        F.sum(hit).alias("_called"),
        F.sum(y).alias("_actual"),
        F.avg((p - y) * (p - y)).alias("brier"),
    )
    scored = base.withColumns(
        {
            "precision": _ratio(F.col("_tp"), F.col("_called")),
            "recall": _ratio(F.col("_tp"), F.col("_actual")),
            "f1": _ratio(2.0 * F.col("_tp"), F.col("_called") + F.col("_actual")),
        }
    ).drop("_tp", "_called", "_actual")
    auc = roc_auc(df, keys, label, prob)
    joined = scored.join(auc, keys, "left") if keys else scored.crossJoin(F.broadcast(auc))
    return joined.select(*keys, "rows", "accuracy", "precision", "recall", "f1", "brier", "roc_auc")


def class_report(df: DataFrame, label: str = "target", predicted: str = "pred") -> DataFrame:
    """Precision, recall, F1 and support per class, then macro and weighted averages."""
    pairs = df.groupBy(label, predicted).agg(F.count("*").alias("_n"))
    # a row per class label from here on
    sides = pairs.select(
        F.explode(
            F.array(
                F.struct(F.col(label).cast("string").alias("class"), F.lit(1).alias("is_actual")),
                F.struct(F.col(predicted).cast("string").alias("class"), F.lit(0).alias("is_actual")),
            )
        ).alias("side"),
        (F.col(label) == F.col(predicted)).alias("_right"),
        "_n",
    ).select("side.*", "_right", "_n")
    actual = F.col("is_actual") == 1
    classes = sides.groupBy("class").agg(
        F.coalesce(F.sum(F.when(actual, F.col("_n"))), F.lit(0)).alias("support"),
        F.coalesce(F.sum(F.when(~actual, F.col("_n"))), F.lit(0)).alias("_called"),
        F.coalesce(F.sum(F.when(actual & F.col("_right"), F.col("_n"))), F.lit(0)).alias("_tp"),
    )
    report = classes.select(
        "class",
        _ratio(F.col("_tp"), F.col("_called")).alias("precision"),
        _ratio(F.col("_tp"), F.col("support")).alias("recall"),
        _ratio(2.0 * F.col("_tp"), F.col("_called") + F.col("support")).alias("f1"),
        "support",
    )
    # each class counts once for itself, once in the plain and once in the weighted mean
    rows = F.array(
        F.struct(F.col("class").alias("c"), F.lit(1.0).alias("w")),
        F.struct(F.lit("macro avg").alias("c"), F.lit(1.0).alias("w")),
        F.struct(F.lit("weighted avg").alias("c"), F.col("support").cast("double").alias("w")),
    )
    measures = ["precision", "recall", "f1"]
    return (
        report.withColumn("_row", F.explode(rows))
        .groupBy(F.col("_row.c").alias("class"))
        .agg(
            *[_ratio(F.sum(F.col(m) * F.col("_row.w")), F.sum("_row.w")).alias(m) for m in measures],
            F.sum("support").alias("support"),
        )
    )


def candidate_order(
    auc: str = "roc_auc", brier: str = "brier", f1: str = "f1", status: str | None = None
) -> list[Column]:
    """Sort columns, best first: AUC, then low Brier, then F1; missing or failed is worst."""
    ok = F.col(status) == "ok" if status else F.lit(True)

    def usable(c: str) -> Column:
        return F.when(ok & ~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))

    return [
        usable(auc).desc_nulls_last(),
        usable(brier).asc_nulls_last(),
        usable(f1).desc_nulls_last(),
    ]
