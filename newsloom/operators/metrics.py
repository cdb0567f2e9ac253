"""Evaluation metrics as aggregates. Predictions are long: one row per case and method.

Columns: gold, pred (labels, REVIEW or FAILED), and whatever ``by`` names. Each report is one grouped pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.values import ratio

from .ruleset import FAILED, OVERFLOW, REVIEW


def label_frame(df: DataFrame, labels: list[str], name: str = "label") -> DataFrame:
    return df.sparkSession.createDataFrame([(x,) for x in labels], f"{name} string")


def unknown_gold(df: DataFrame, labels: list[str]) -> DataFrame:
    """Gold labels that are no label: an evaluation with any is invalid."""
    return df.where(~F.col("gold").isin(labels) | F.col("gold").isNull()).select("gold").distinct()


def bucketed(pred: Column, labels: list[str]) -> Column:
    return F.when(pred.isin([*labels, REVIEW, FAILED, OVERFLOW]), pred).otherwise(OVERFLOW)


def confusion(df: DataFrame, labels: list[str]) -> DataFrame:
    """gold, pred, n over the dense grid of labels and labels with review, failed and overflow."""
    counts = df.select("gold", bucketed(F.col("pred"), labels).alias("pred")).groupBy("gold", "pred").agg(F.count(F.lit(1)).alias("n"))
    # both sides of the grid are the label list, whose size is the classifier's
    grid = label_frame(df, labels, "gold").join(F.broadcast(label_frame(df, [*labels, REVIEW, FAILED, OVERFLOW], "pred")), how="cross")
    return grid.join(counts, ["gold", "pred"], "left").select("gold", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def per_class(df: DataFrame, labels: list[str], by: list[str] | None = None) -> DataFrame:
    """by..., label, precision, recall, f1, support; review and failure count against recall."""
    by = by or []
    each = df.select(*by, "gold", "pred", F.explode(F.array_distinct(F.array("gold", "pred"))).alias("label")).where(F.col("label").isin(labels))
    sums = each.groupBy(*by, "label").agg(
        F.count_if((F.col("gold") == F.col("label")) & (F.col("pred") == F.col("label"))).alias("tp"),
        F.count_if(F.col("gold") == F.col("label")).alias("support"), F.count_if((F.col("pred") == F.col("label")) & F.col("gold").isin(labels)).alias("predicted"),
    )
    groups = df.select(*by).distinct() if by else None
    grid = label_frame(df, labels) if groups is None else groups.join(F.broadcast(label_frame(df, labels)), how="cross")
    full = grid.join(sums, [*by, "label"], "left").fillna(0, ["tp", "support", "predicted"])
    p, r = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    return full.select(*by, "label", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), "support")


def overall(df: DataFrame, labels: list[str], by: list[str] | None = None) -> DataFrame:
    """Accuracy, macro averages over all labels, coverage and what is decided, for each group."""
    by = by or []
    decided = F.col("pred").isin(labels)
    right = decided & (F.col("gold") == F.col("pred"))
    n = F.count(F.lit(1))
    sums = df.groupBy(*by).agg(
        n.alias("total"), (F.count_if(right) / n).alias("accuracy"), (F.count_if(decided) / n).alias("coverage"),
        ratio(F.count_if(right), F.count_if(decided)).alias("decided_accuracy"), F.count_if(F.col("pred") == REVIEW).alias("review_count"),
        F.count_if(F.col("pred") == FAILED).alias("error_count"), (F.count_if(F.col("pred") == REVIEW) / n).alias("review_rate"),
        F.count_if(decided & (F.col("gold") != F.col("pred"))).alias("wrong_decided_count"),
    )
    macro = per_class(df, labels, by).groupBy(*by).agg(*[(F.sum(c) / len(labels)).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])
    return sums.join(macro, by) if by else sums.join(F.broadcast(macro), how="cross")  # one row each


def rule_corrections(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """What rules did to the model's labels; columns gold, model, pred, applied."""
    used = F.col("applied")
    changed = used & (F.col("model") != F.col("pred"))
    wrong = F.count_if(used & (F.col("gold") != F.col("pred")))
    return df.groupBy(*(by or [])).agg(
        F.count_if(used).alias("rule_applied_count"), F.count_if(changed).alias("rule_changed_count"), wrong.alias("wrong_rule_count"), ratio(wrong, F.count_if(used)).alias("wrong_rule_rate"),
        F.count_if(changed & (F.col("model") != F.col("gold")) & (F.col("pred") == F.col("gold"))).alias("corrected_count"),
        F.count_if(changed & (F.col("model") == F.col("gold")) & (F.col("pred") != F.col("gold"))).alias("harmful_change_count"),
    )


def label_bias(df: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """How often other topics are taken for one label."""
    others = F.count_if(F.col("gold") != label)
    false = F.count_if((F.col("gold") != label) & (F.col("pred") == label))
    return df.groupBy(*(by or [])).agg(others.alias("other_support"), false.alias("false_positive_count"), ratio(false, others).alias("false_positive_rate"), F.count_if(F.col("pred") == label).alias("predicted_count"))


def summary(df: DataFrame) -> DataFrame:
    """One row of run statistics; columns group_article_count, confidence, applied, final_label."""
    return df.agg(
        F.coalesce(F.sum(original_articles(F.col("group_article_count"))), F.lit(0)).alias("collected"), F.count(F.lit(1)).alias("representatives"),
        F.count_if(F.col("confidence") == "낮음").alias("low_confidence"), F.count_if(F.col("applied")).alias("rule_applied"),
        F.count_if(F.col("final_label") == REVIEW).alias("review_required"), F.count_if(F.col("final_label") == FAILED).alias("errors"),
    )


def category_counts(df: DataFrame, label: str = "final_label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def original_articles(count: Column) -> Column:
    """A stored group size as a number: what is missing, unreadable or below 1 counts as 1."""
    return F.greatest(F.coalesce(count.cast("string").try_cast("double"), F.lit(1.0)), F.lit(1.0)).cast("long")


def markdown(rows: list[tuple], header: list[str]) -> str:
    """A small driver-side table."""
    lines = [header, ["---"] * len(header), *rows]
    return "\n".join(f"| {' | '.join(f'{x:.4f}' if isinstance(x, float) else str(x) for x in r)} |" for r in lines) + "\n"
