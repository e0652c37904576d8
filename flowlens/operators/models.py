"""Classifiers on feature tables, built from Spark ML stages."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    OneVsRest,
)
from pyspark.ml.feature import IndexToString, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlens.operators import metrics
from flowlens.operators.encode import Dictionary
from flowlens.operators.perceptron import PerceptronClassifier
from flowlens.operators.stages import ForestClassifier
from flowlens.operators.stats import Normalization, class_weights, with_class_weight
from flowlens.schema import FEATURE_COLUMNS, LABEL

# Fixed value: the deepest tree Spark ML allows, for trees without a depth limit.
DEEPEST = 30
SEED = 42


def decision_tree(min_rows: int = 200, depth: int = DEEPEST, seed: int = SEED) -> DecisionTreeClassifier:
    return DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=min_rows, seed=seed)


def random_forest(
    trees: int = 400, min_rows: int = 10, depth: int = DEEPEST, bins: int = 32, seed: int = SEED
) -> ForestClassifier:
    return ForestClassifier(
        numTrees=trees,
        minInstancesPerNode=min_rows,
        maxDepth=depth,
        maxBins=bins,
        featureSubsetStrategy="sqrt",
        seed=seed,
    )


def histogram_forest(trees: int = 400, depth: int = 16, bins: int = 64, seed: int = SEED) -> ForestClassifier:
    return random_forest(trees=trees, depth=depth, bins=bins, seed=seed)


def boosting(
    rounds: int = 400, depth: int = 6, bins: int = 256, step: float = 0.1, parallelism: int = 4, seed: int = SEED
) -> OneVsRest:
    """One boosted binary model per class; `parallelism` classes are fitted at a time."""
    booster = GBTClassifier(
        maxIter=rounds,
        maxDepth=depth,
        maxBins=bins,
        stepSize=step,
        subsamplingRate=0.8,
        featureSubsetStrategy="0.8",
        seed=seed,
    )
    return OneVsRest(classifier=booster, parallelism=parallelism)


def perceptron(inputs: int, classes: int, hidden: Sequence[int] = (128,), rounds: int = 100, seed: int = SEED):
    """Network over flattened sequences, tabular values and the version indicator."""
    return PerceptronClassifier(layers=[inputs, *hidden, classes], maxIter=rounds, seed=seed)


def train(
    rows: DataFrame,
    classifier,
    features: Sequence[str] = FEATURE_COLUMNS,
    label: str = LABEL,
    balanced: bool = False,
) -> PipelineModel:
    """Label indexing (sorted names), feature assembly, classifier, label decoding.

    `balanced` weighs each row by rows / (classes * class count).
    """
    rows = rows.filter(F.col(label).isNotNull())
    indexer = StringIndexer(
        inputCol=label, outputCol="label", stringOrderType="alphabetAsc", handleInvalid="skip"
    ).fit(rows)
    if len(indexer.labels) < 2:
        raise ValueError("training needs at least two classes")
    if balanced:
        rows = with_class_weight(rows, class_weights(rows, label, Dictionary.fit(rows, label)), label)
        classifier = classifier.copy().setWeightCol("weight")
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    decoder = IndexToString(inputCol="prediction", outputCol="y_pred", labels=indexer.labels)
    return Pipeline(stages=[indexer, assembler, classifier, decoder]).fit(rows)


def train_vectors(
    rows: DataFrame, classifier, vector: str = "inputs", label: str = LABEL
) -> PipelineModel:
    """Like `train` for rows that already hold one array of inputs."""
    rows = as_vectors(rows.filter(F.col(label).isNotNull()), vector)
    indexer = StringIndexer(
        inputCol=label, outputCol="label", stringOrderType="alphabetAsc", handleInvalid="skip"
    ).fit(rows)
    decoder = IndexToString(inputCol="prediction", outputCol="y_pred", labels=indexer.labels)
    return Pipeline(stages=[indexer, classifier, decoder]).fit(rows)


def as_vectors(rows: DataFrame, vector: str = "inputs") -> DataFrame:
    """Array of inputs as the feature vector."""
    return rows.withColumn("features", array_to_vector(vector))


def scorer(model: PipelineModel) -> PipelineModel:
    """The model without its label stage, so unlabelled rows can be scored."""
    return PipelineModel([s for s in model.stages if not isinstance(s, StringIndexerModel)])


def network_inputs(samples: DataFrame, versions: int, name: str = "inputs") -> DataFrame:
    """Normalized samples flattened to one array: sequences, tabular, version indicator."""
    slots = F.sequence(F.lit(0), F.lit(versions))
    indicator = F.transform(slots, lambda i: (i == F.col("version_idx")).cast("double"))
    return samples.withColumn(name, F.concat(F.flatten("sequences"), "tabular", indicator))


def network_width(versions: int, tabular: int = 45, length: int = 30) -> int:
    return 3 * length + tabular + versions + 1


def select_best(candidates: dict, training: DataFrame, validation: DataFrame | None, fit) -> tuple[str, PipelineModel, DataFrame]:
    """Fit every candidate and keep the best by validation (else training) accuracy.

    The first candidate wins ties. Also returns one row of metrics per candidate.
    """
    rows, best = [], None
    judged = training if validation is None else validation
    for name, candidate in candidates.items():
        model = fit(training, candidate)
        scored = scorer(model).transform(judged.filter(F.col(LABEL).isNotNull()))
        result = metrics.summary(scored.select(F.col(LABEL).alias("y_true"), "y_pred")).first()
        rows.append((name, result["rows"], result["accuracy"], result["macro_f1"]))
        if best is None or (result["accuracy"] or 0.0) > best[0]:
            best = (result["accuracy"] or 0.0, name, model)
    table = training.sparkSession.createDataFrame(
        rows, "candidate string, rows long, accuracy double, macro_f1 double"
    )
    return best[1], best[2], table.withColumn("selected", F.col("candidate") == best[1])


def feature_importance(model: PipelineModel, features: Sequence[str] = FEATURE_COLUMNS) -> DataFrame:
    """Importance of every feature of a fitted tree model, most important first."""
    tree = next(s for s in model.stages if hasattr(s, "featureImportances"))
    rows = list(zip(features, [float(v) for v in tree.featureImportances.toArray()]))
    table = SparkSession.active().createDataFrame(rows, "feature string, importance double")
    return table.orderBy(F.col("importance").desc(), "feature")


BUNDLE_VERSION = 1


@dataclass
class Bundle:
    """A model with all that scoring needs, stored and loaded as one unit."""

    model: PipelineModel
    features: list[str]
    labels: list[str]
    versions: list[int]
    normalization: Normalization | None = None
    parameters: dict[str, str] = field(default_factory=dict)

    def save(self, path: str) -> None:
        """The model, and a description that names its parts; the description is written last."""
        spark = SparkSession.active()
        save(self.model, f"{path}/model")
        held = self.normalization
        moments = None if held is None else [held.seq_mean, held.seq_std, held.tab_mean, held.tab_std]
        row = (BUNDLE_VERSION, self.features, self.labels, self.versions, moments, {k: str(x) for k, x in self.parameters.items()})
        spark.createDataFrame([row], _BUNDLE).coalesce(1).write.mode("overwrite").json(f"{path}/description")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Bundle":
        """The bundle; a missing or unfit description is an error, as is a model of other labels."""
        row = spark.read.schema(_BUNDLE).json(f"{path}/description").first()
        missing = ["description"] if row is None else [f for f in ("version", "features", "labels", "versions", "parameters") if row[f] is None]
        if missing:
            raise ValueError(f"the bundle at {path} lacks {', '.join(missing)}")
        if row["version"] != BUNDLE_VERSION:
            raise ValueError(f"bundle version {row['version']}, expected {BUNDLE_VERSION}")
        model = load(f"{path}/model")
        known = next((s.getLabels() for s in model.stages if isinstance(s, IndexToString)), None)
        if known != list(row["labels"]):
            raise ValueError("the description names other labels than the model")
        moments = row["moments"]
        normalization = None if moments is None else Normalization(*map(list, moments))
        return cls(model, list(row["features"]), list(row["labels"]), list(row["versions"]), normalization, dict(row["parameters"]))


_BUNDLE = (
    "version int, features array<string>, labels array<string>, versions array<long>, "
    "moments array<array<double>>, parameters map<string,string>"
)


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
