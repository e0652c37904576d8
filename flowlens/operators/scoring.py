"""Batch scoring: request checks, predictions with confidence, evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from flowlens.functions.sequence import conform, has_shape
from flowlens.operators import metrics
from flowlens.operators.models import as_vectors, network_inputs, scorer
from flowlens.operators.stats import Normalization
from flowlens.schema import LABEL, SEQUENCE_LENGTH

# Fixed value: label shown for requests that cannot be scored.
ERROR_LABEL = "API_ERROR"
REQUEST_COLUMNS = ["sequences", "tabular", "version_idx"]


def with_validity(requests: DataFrame, length: int = SEQUENCE_LENGTH) -> DataFrame:
    return requests.withColumn("valid", has_shape(F.col("sequences"), 3, length))


def split_requests(requests: DataFrame, length: int = SEQUENCE_LENGTH) -> tuple[DataFrame, DataFrame]:
    """Requests of the right shape, and the others with an error label and reason."""
    checked = with_validity(requests, length)
    bad = checked.filter(~F.col("valid")).drop("valid")
    reason = F.format_string(
        "expected 3 channels of %d values, got %d", F.lit(length), F.coalesce(F.size("sequences"), F.lit(0))
    )
    return (
        checked.filter("valid").drop("valid"),
        bad.withColumns({"label": F.lit(ERROR_LABEL), "error": reason}),
    )


def conform_tabular(requests: DataFrame, width: int) -> DataFrame:
    """Tabular vectors padded or cut to `width`; `conformed` flags the changed rows."""
    return requests.withColumn(
        "conformed", F.coalesce(F.size("tabular") != width, F.lit(True))
    ).withColumn("tabular", conform(F.col("tabular"), width))


def score(model: PipelineModel, rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Predicted label and confidence per row."""
    scored = with_probabilities(scorer(model).transform(rows))
    return scored.select(*keep, "y_pred", F.round(F.array_max("probabilities"), 4).alias("confidence"))


def with_probabilities(scored: DataFrame) -> DataFrame:
    """Class probabilities as an array that sums to 1.

    One-versus-rest models only have a margin per class: its logistic value, shared out over the
    classes, keeps their order.
    """
    if "probability" in scored.columns:
        return scored.withColumn("probabilities", vector_to_array("probability"))
    share = F.transform(vector_to_array("rawPrediction"), lambda x: 1 / (1 + F.exp(-2 * x)))
    total = F.aggregate(share, F.lit(0.0), lambda a, x: a + x)
    return scored.withColumn("probabilities", F.transform(share, lambda x: x / total))


def evaluate_loss(model: PipelineModel, rows: DataFrame, label: str = LABEL) -> DataFrame:
    """Rows, hits, summed and mean log loss of a model on labelled rows; unknown labels get no probability."""
    labels = model.stages[-1].getLabels()
    known = rows.filter(F.col(label).isNotNull())
    scored = with_probabilities(scorer(model).transform(known))
    place = F.array_position(F.lit(list(labels)), F.col(label)).cast("int")
    mine = F.when(place > 0, F.get("probabilities", place - 1)).otherwise(F.lit(0.0))
    judged = scored.select(F.col(label).alias("y_true"), "y_pred", mine.alias("_p"))
    return metrics.log_loss(judged, F.col("_p"))


def score_with_truth(model: PipelineModel, rows: DataFrame, label: str = LABEL, keep: Sequence[str] = ()) -> DataFrame:
    """Scores next to the true label, with a match flag."""
    scored = score(model, rows, keep=[*keep, label])
    return scored.withColumnRenamed(label, "y_true").withColumn(
        "matches", F.coalesce(F.col("y_true") == F.col("y_pred"), F.lit(False))
    )


def score_requests(
    model: PipelineModel,
    requests: DataFrame,
    normalization: Normalization,
    versions: int,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Label and confidence of sample requests; malformed ones become error rows.

    Requests are checked, brought to the trained width, normalized and scored in one
    pass; `versions` is the number of versions known in training.
    """
    width = len(normalization.tab_mean)
    good, bad = split_requests(requests.select(*keep, *REQUEST_COLUMNS))
    inputs = network_inputs(normalization.apply(conform_tabular(good, width)), versions)
    scored = score(model, as_vectors(inputs), keep=keep).withColumnRenamed("y_pred", "label")
    return scored.withColumn("error", F.lit(None).cast("string")).unionByName(
        bad.select(*keep, "label", F.lit(None).cast("double").alias("confidence"), "error")
    )


def evaluate(model: PipelineModel, rows: DataFrame, label: str = LABEL) -> tuple[DataFrame, DataFrame]:
    """Summary row and per-class report of a model on labelled rows."""
    known = rows.filter(F.col(label).isNotNull())
    predictions = scorer(model).transform(known).select(F.col(label).alias("y_true"), "y_pred")
    return metrics.summary(predictions), metrics.class_report(predictions)
