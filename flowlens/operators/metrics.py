"""Evaluation reports from prediction tables; everything starts from the confusion counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from flowlens.operators.encode import Dictionary
from flowlens.operators.joins import join_same
from flowlens.operators.ordered import ROWS_PER_TASK, OrderedRows

# Fixed value: keeps the all-class F1 finite for absent classes.
EPSILON = 1e-9


def confusion(predictions: DataFrame, truth: str = "y_true", guess: str = "y_pred") -> DataFrame:
    """Rows per (truth, guess) pair."""
    return predictions.groupBy(
        F.col(truth).alias("y_true"), F.col(guess).alias("y_pred")
    ).agg(F.count(F.lit(1)).alias("rows"))


def confusion_matrix(predictions: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Wide confusion matrix with one column per known label."""
    return predictions.groupBy("y_true").pivot("y_pred", list(labels)).count().na.fill(0)


def accuracy(predictions: DataFrame) -> DataFrame:
    hit = (F.col("y_true") == F.col("y_pred")).cast("double")
    return predictions.agg(F.count(F.lit(1)).alias("rows"), F.avg(hit).alias("accuracy"))


def _class_totals(predictions: DataFrame) -> DataFrame:
    """True positives, support and predicted rows per label seen in truth or guess."""
    pair = F.explode(
        F.array(
            F.struct(F.col("y_true").alias("label"), F.lit(1).alias("support"), F.lit(0).alias("guessed")),
            F.struct(F.col("y_pred").alias("label"), F.lit(0).alias("support"), F.lit(1).alias("guessed")),
        )
    )
    sides = confusion(predictions).select("y_true", "y_pred", "rows", pair.alias("side"))
    hit = (F.col("y_true") == F.col("y_pred")) & (F.col("side.support") == 1)
    return sides.groupBy(F.col("side.label").alias("label")).agg(
        F.sum(F.col("side.support") * F.col("rows")).alias("support"),
        F.sum(F.col("side.guessed") * F.col("rows")).alias("guessed"),
        F.sum(F.when(hit, F.col("rows")).otherwise(F.lit(0))).alias("correct"),
    )


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def class_report(predictions: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per label; undefined ratios are 0."""
    precision = _share(F.col("correct"), F.col("guessed"))
    recall = _share(F.col("correct"), F.col("support"))
    both = F.col("guessed") + F.col("support")
    return _class_totals(predictions).select(
        "label",
        precision.alias("precision"),
        recall.alias("recall"),
        _share(2.0 * F.col("correct"), both).alias("f1"),
        "support",
        "correct",
    )


def class_accuracy(predictions: DataFrame) -> DataFrame:
    """Classes with support by falling accuracy, ties by name."""
    return (
        class_report(predictions)
        .filter(F.col("support") > 0)
        .select("label", "support", "correct", F.col("recall").alias("accuracy"), "f1")
        .orderBy(F.col("accuracy").desc(), "label")
    )


def top_by_support(predictions: DataFrame, rows: int = 10) -> DataFrame:
    return (
        class_report(predictions)
        .select("label", "precision", "recall", "f1", "support")
        .orderBy(F.col("support").desc(), "label")
        .limit(rows)
    )


def macro_f1(predictions: DataFrame) -> DataFrame:
    """Mean F1 over the labels that occur in truth or guess."""
    return class_report(predictions).agg(
        F.count(F.lit(1)).alias("classes"), F.avg("f1").alias("macro_f1")
    )


def macro_f1_all(predictions: DataFrame, labels: Dictionary) -> DataFrame:
    """Mean F1 over every class of the dictionary; an absent class counts as 0."""
    classes = labels.frame.select(F.col("value").alias("label"))
    totals = join_same(classes, _class_totals(predictions), ["label"], "left").na.fill(
        0, ["support", "guessed", "correct"]
    )
    precision = F.col("correct") / (F.col("guessed") + EPSILON)
    recall = F.col("correct") / (F.col("support") + EPSILON)
    f1 = 2 * precision * recall / (precision + recall + EPSILON)
    return totals.agg(F.count(F.lit(1)).alias("classes"), F.avg(f1).alias("macro_f1"))


def summary(predictions: DataFrame) -> DataFrame:
    """Rows, accuracy and macro F1 in one row."""
    report = class_report(predictions)
    return report.agg(
        F.sum("support").cast("long").alias("rows"),
        F.try_divide(F.sum("correct"), F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
    )


def log_loss(predictions: DataFrame, probability: Column, floor: float = 1e-15) -> DataFrame:
    """Summed and mean negative log probability of the true class, with hits and rows."""
    loss = -F.ln(F.greatest(probability, F.lit(floor)))
    hit = (F.col("y_true") == F.col("y_pred")).cast("long")
    return predictions.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(hit).alias("correct"),
        F.sum(loss).alias("loss_sum"),
        F.avg(loss).alias("log_loss"),
    )


def running_accuracy(
    predictions: DataFrame,
    chunk: str,
    order: Sequence[str],
    every: int,
    rows_per_task: int = ROWS_PER_TASK,
    probability: Column | None = None,
    floor: float = 1e-15,
) -> DataFrame:
    """Accuracy since the start of a chunk, after every `every` rows of it.

    With the probability of the true class also the mean loss so far.
    """
    hit = F.coalesce((F.col("y_true") == F.col("y_pred")).cast("long"), F.lit(0))
    rows = OrderedRows.of(predictions, [chunk], order, rows_per_task)
    sums = {"rows": F.lit(1), "correct": hit}
    if probability is not None:
        sums["_loss"] = -F.ln(F.greatest(probability, F.lit(floor)))
    running = rows.with_running(sums=sums).frame().filter(F.col("rows") % every == 0)
    columns = [chunk, "rows", "correct", (F.col("correct") / F.col("rows")).alias("accuracy")]
    if probability is not None:
        columns.append((F.col("_loss") / F.col("rows")).alias("loss"))
    return running.select(*columns)


def grouped_accuracy(predictions: DataFrame, group: str) -> DataFrame:
    hit = (F.col("y_true") == F.col("y_pred")).cast("double")
    return predictions.groupBy(group).agg(F.count(F.lit(1)).alias("rows"), F.avg(hit).alias("accuracy"))


def argmax(probabilities: Column) -> tuple[Column, Column]:
    """Index of the largest probability (the first on ties) and its value."""
    best = F.array_max(probabilities)
    return (F.array_position(probabilities, best) - 1).cast("int"), best
