"""Queries: model fits, scoring and evaluation on the flow features."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowlens.operators import boosting, forest, metrics, models, network, sampling, scoring, sequences, stats, tabular
from flowlens.operators.encode import Dictionary
from flowlens.plans import views as v
from flowlens.plans.registry import query, r6
from flowlens.schema import FEATURE_COLUMNS
from flowlens.session import scratch_path
from flowlens.sources.writers import write_features


CLASSES = ["up-long", "up-short", "down-long", "down-short"]
# Of a hundred flows, so many get a class that nothing in their features tells.
STRAY = 15


def _with_class(flows: DataFrame) -> DataFrame:
    """Flows labelled by main direction and length, but for a share of stray ones that no input determines."""
    main = F.when(F.col("BYTES") >= F.col("BYTES_REV"), "up").otherwise("down")
    length = F.when(F.col("PACKETS") + F.col("PACKETS_REV") >= 6, "long").otherwise("short")
    stray = F.get(F.array(*[F.lit(c) for c in CLASSES]), (F.col("head_id") % 4).cast("int"))
    told = F.concat_ws("-", main, length)
    return flows.withColumn("APP", F.when(F.col("head_id") * 7919 % 100 < STRAY, stray).otherwise(told))


def _write(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table written once with its split flag, as training and validation rows."""
    split = sampling.stratified_split(table, "APP", "head_id", 0.2, score=v.score_of("head_id"))
    written = write_features(split, scratch_path(table.sparkSession, "learn"), "v1", ["is_validation"])
    return written.filter(~F.col("is_validation")), written.filter("is_validation")


def features(spark, sf) -> tuple[DataFrame, DataFrame]:
    table = tabular.feature_table(_with_class(v.flows(spark, sf)), None, keep=["ID", "head_id", "APP"])
    return _write(table)


def _summary(name: str, model, rows: DataFrame) -> DataFrame:
    summary, _ = scoring.evaluate(model, rows)
    return summary.select(F.lit(name).alias("model"), "rows", r6(F.col("accuracy")).alias("accuracy"),
                          r6(F.col("macro_f1")).alias("macro_f1"))


@query("model_dt")
def model_dt(spark, sf):
    train, valid = features(spark, sf)
    return _summary("decision tree", models.train(train, models.decision_tree()), valid)


@query("model_rf")
def model_rf(spark, sf):
    train, valid = features(spark, sf)
    return _summary("random forest", models.train(train, models.random_forest(), balanced=True), valid)


@query("model_rf_hist")
def model_rf_hist(spark, sf):
    train, valid = features(spark, sf)
    return _summary("histogram forest", models.train(train, models.histogram_forest()), valid)


@query("model_forest")
def model_forest(spark, sf):
    """Validation metrics of the forest whose class weights are balanced in every bag."""
    train, valid = features(spark, sf)
    scored = forest.fit(train, key="head_id").score(valid.withColumnRenamed("APP", "y_true"), ["y_true"])
    summary = metrics.summary(scored.select("y_true", "y_pred"))
    return summary.select(F.lit("balanced forest").alias("model"), "rows", r6(F.col("accuracy")).alias("accuracy"),
                          r6(F.col("macro_f1")).alias("macro_f1"))


def _bags_sql() -> str:
    settings, low = forest.Settings(), 2**32
    (first, a), (second, b) = forest.MIX
    return f"""
    , seeded AS (
      SELECT APP AS label, CAST(t AS INTEGER) AS tree,
             xor(xor(head_id, head_id >> 32) & {low - 1}, CAST(({settings.seed} + (t + 1) * {forest.TREE_STEP}) % {low} AS BIGINT)) AS x
      FROM flows, range({settings.trees}) r(t) WHERE APP IS NOT NULL),
    once AS (SELECT label, tree, CAST(xor(x, x >> {first})::HUGEINT * {a} % {low} AS BIGINT) AS x FROM seeded),
    twice AS (SELECT label, tree, CAST(xor(x, x >> {second})::HUGEINT * {b} % {low} AS BIGINT) AS x FROM once),
    times AS (SELECT label, tree, len(list_filter({forest.DRAW_EDGES}, lambda e: e <= xor(x, x >> 16))) AS n FROM twice),
    held AS (SELECT tree, label, CAST(sum(n) AS BIGINT) AS drawn FROM times GROUP BY tree, label)
    SELECT tree, label, drawn,
           round(CASE WHEN drawn = 0 THEN 0 ELSE sum(drawn) OVER of_tree * 1.0::DOUBLE / count(*) FILTER (WHERE drawn > 0) OVER of_tree / drawn END, 6) AS weight
    FROM held WINDOW of_tree AS (PARTITION BY tree)
    """


@query("forest_bags", _bags_sql())
def forest_bags(spark, sf):
    """Rows drawn and class weight of every class in every bag of the default forest."""
    rows = v.flows(spark, sf, text=False, stored=True)
    return forest.bags(rows, "head_id").withColumn("weight", r6(F.col("weight")))


@query("model_gbt")
def model_gbt(spark, sf):
    """Validation metrics of boosted trees, from the round with the lowest validation loss."""
    train, valid = features(spark, sf)
    scored = boosting.fit(train, valid).score(valid.withColumnRenamed("APP", "y_true"), ["y_true"])
    summary = metrics.summary(scored.select("y_true", "y_pred"))
    return summary.select(F.lit("boosting").alias("model"), "rows", r6(F.col("accuracy")).alias("accuracy"),
                          r6(F.col("macro_f1")).alias("macro_f1"))


@query("model_rounds")
def model_rounds(spark, sf):
    """Loss and accuracy on training and validation rows after every round of boosting, and the round kept."""
    train, valid = features(spark, sf)
    return boosting.fit(train, valid).rounds()


ROOT_CUTS = {"PACKETS": [0, 1, 2, 4, 8, 16], "PPI_LEN": [1, 2, 4, 8, 16, 29], "PPI_ROUNDTRIPS": [0, 1, 3, 6]}


def _root_sql() -> str:
    values = ", ".join(f"{{'f': '{f}', 'v': CAST({f} AS BIGINT), 'c': {c}}}" for f, c in ROOT_CUTS.items())
    return f"""
    , classes AS (SELECT DISTINCT APP AS label, (SELECT count(DISTINCT APP) FROM flows) AS n FROM flows WHERE APP IS NOT NULL),
    spread AS (SELECT APP, unnest([{values}]) AS x FROM flows WHERE APP IS NOT NULL),
    binned AS (SELECT APP, x.f AS feature, CAST(len(list_filter(x.c, lambda c: c < x.v)) AS INTEGER) AS bin FROM spread)
    SELECT label, feature, bin, round(count(*) / n - count(*) FILTER (WHERE APP = label), 6) AS g,
           round(count(*) * 2.0::DOUBLE / n * (1 - 1.0::DOUBLE / n), 6) AS h
    FROM binned, classes GROUP BY label, n, feature, bin
    """


@query("boost_sums", _root_sql())
def boost_sums(spark, sf):
    """Sums of gradients and hessians in the roots of the first round, which all splits start from."""
    rows = v.flows(spark, sf, text=False, stored=True)
    settings = boosting.Settings(rows_share=1.0)
    sums = boosting.root_sums(rows, list(ROOT_CUTS), list(ROOT_CUTS.values()), settings=settings)
    return sums.select("label", "feature", "bin", r6(F.col("g")).alias("g"), r6(F.col("h")).alias("h"))


def _samples(spark, sf):
    """Training and validation samples, the statistics of the former and the number of known versions."""
    flows = _with_class(v.flows(spark, sf, stored=True))
    versions = Dictionary.fit(flows, "QUIC_VERSION", first=1)
    samples = sequences.samples(flows, None, versions, keep=["ID", "head_id", "APP"])
    train, valid = _write(samples)
    return train, valid, stats.Normalization.fit(train, sequences.TABULAR_WIDTH), versions.frame.count()


def _network(spark, sf):
    """Trained network with all that scoring needs, and its validation samples."""
    train, valid, normalization, known = _samples(spark, sf)
    inputs = models.network_inputs(normalization.apply(train), known)
    perceptron = models.perceptron(models.network_width(known), 4)
    return models.train_vectors(inputs, perceptron), normalization, known, valid


def _weighted(spark, sf):
    """The class-weighted network and its validation inputs."""
    train, valid, normalization, known = _samples(spark, sf)
    held, judged = (models.network_inputs(normalization.apply(rows), known) for rows in (train, valid))
    return network.fit(held, judged), judged


@query("model_network")
def model_network(spark, sf):
    """Validation metrics of the class-weighted network, from the epoch that the same validation rows chose."""
    net, judged = _weighted(spark, sf)
    summary = metrics.summary(net.score(judged.withColumnRenamed("APP", "y_true"), ["y_true"]).select("y_true", "y_pred"))
    return summary.select(F.lit("network").alias("model"), "rows", r6(F.col("accuracy")).alias("accuracy"),
                          r6(F.col("macro_f1")).alias("macro_f1"))


@query("network_epochs")
def network_epochs(spark, sf):
    """Weighted loss and accuracy on training and validation rows after every epoch, and the epoch kept."""
    return _weighted(spark, sf)[0].epochs()


SLOPE_INPUTS = ["PACKETS", "PPI_LEN", "PPI_ROUNDTRIPS"]
_SMOOTHING = network.Settings().smoothing


def _slope_sql() -> str:
    inputs = ", ".join(f"{{'f': '{f}', 'v': CAST({f} AS DOUBLE)}}" for f in SLOPE_INPUTS)
    return f"""
    , classes AS (
      SELECT APP AS label, sum(count(*)) OVER () * 1.0::DOUBLE / (count(*) OVER () * count(*)) AS w, count(*) OVER () AS n
      FROM flows WHERE APP IS NOT NULL GROUP BY APP),
    spread AS (SELECT APP, unnest([{inputs}, {{'f': '(bias)', 'v': 1.0::DOUBLE}}]) AS x FROM flows WHERE APP IS NOT NULL),
    sums AS (SELECT APP, x.f AS input, sum(x.v) AS total FROM spread GROUP BY ALL),
    whole AS (SELECT sum(w) AS all_w FROM classes),
    held AS (SELECT count(*) AS rows FROM flows WHERE APP IS NOT NULL)
    SELECT c.label, s.input,
           round(sum(s.total * (((1 - {_SMOOTHING}) * o.w + {_SMOOTHING} / c.n * all_w) / c.n
                 - c.w * ((CASE WHEN o.label = c.label THEN 1 - {_SMOOTHING} ELSE 0 END) + {_SMOOTHING} / c.n))) / any_value(rows), 6) AS slope
    FROM classes c, sums s JOIN classes o ON o.label = s.APP, whole, held GROUP BY c.label, s.input
    """


@query("network_slopes", _slope_sql())
def network_slopes(spark, sf):
    """Weighted gradient sums of the first step over all rows, which the parameters of a network without hidden layers move by."""
    rows = v.flows(spark, sf, text=False, stored=True)
    held = rows.withColumn("inputs", F.array(*[F.col(c).cast("double") for c in SLOPE_INPUTS]))
    settings = network.Settings(hidden=(), steps=1)
    return network.first_gradient(held, SLOPE_INPUTS, settings=settings).withColumn("slope", r6(F.col("slope")))


@query("model_mlp")
def model_mlp(spark, sf):
    model, normalization, known, valid = _network(spark, sf)
    inputs = models.as_vectors(models.network_inputs(normalization.apply(valid), known))
    return _summary("perceptron", model, inputs)


@query("score_requests")
def score_requests(spark, sf):
    model, normalization, known, valid = _network(spark, sf)
    broken = F.when(F.col("head_id") % 11 == 0, F.slice("sequences", 1, 2)).otherwise(F.col("sequences"))
    requests = valid.withColumn("sequences", broken)
    return scoring.score_requests(model, requests, normalization, known, keep=["ID"])


@query("score_batch")
def score_batch(spark, sf):
    train, valid = features(spark, sf)
    model = models.train(train, models.decision_tree())
    return scoring.score_with_truth(model, valid, keep=["ID"])


@query("evaluate")
def evaluate(spark, sf):
    train, valid = features(spark, sf)
    return scoring.evaluate(models.train(train, models.decision_tree()), valid)[1]


@query("model_select")
def model_select(spark, sf):
    train, valid = features(spark, sf)
    candidates = {f"leaf-{n}": models.decision_tree(min_rows=n) for n in (200, 50)}
    return models.select_best(candidates, train, valid, models.train)[2]


@query("feature_importance")
def feature_importance(spark, sf):
    train, _ = features(spark, sf)
    return models.feature_importance(models.train(train, models.decision_tree()))


# The exact part of scoring and evaluation: which rows are scored, with which true label.
_HELD = f"""
    , classed AS (
      SELECT ID, head_id, CASE WHEN head_id * 7919 % 100 < {STRAY} THEN {CLASSES}[head_id % 4 + 1]
             ELSE (CASE WHEN BYTES >= BYTES_REV THEN 'up' ELSE 'down' END) || '-'
             || (CASE WHEN PACKETS + PACKETS_REV >= 6 THEN 'long' ELSE 'short' END) END AS y_true FROM flows
    ),
    held AS (
      SELECT * FROM (
        SELECT *, row_number() OVER (
                 PARTITION BY y_true ORDER BY head_id % {v.SCORE_RANGE} * {v.SCORE_FACTOR} % {v.SCORE_RANGE}, head_id
               ) <= round(0.2 * count(*) OVER (PARTITION BY y_true)) AS chosen
        FROM classed) WHERE chosen
    )
"""


@query("score_rows", _HELD + "SELECT ID, y_true, true AS scored FROM held")
def score_rows(spark, sf):
    """Every validation row is scored once: a label that training knew and a confidence of 0 to 1."""
    scored = score_batch(spark, sf)
    fine = F.col("y_pred").isin(CLASSES) & F.col("confidence").between(0, 1)
    return scored.select("ID", "y_true", F.coalesce(fine, F.lit(False)).alias("scored"))


@query("score_bundle", _HELD + "SELECT ID, y_true, true AS scored, 67 AS inputs FROM held")
def score_bundle(spark, sf):
    """Scores from a stored bundle alone: model, labels and feature list come from the loaded unit."""
    train, valid = features(spark, sf)
    model = models.train(train, models.decision_tree())
    path = scratch_path(spark, "bundle")
    models.Bundle(model, FEATURE_COLUMNS, model.stages[-1].getLabels(), [], parameters={"min_rows": 200}).save(path)
    bundle = models.Bundle.load(spark, path)
    scored = scoring.score_with_truth(bundle.model, valid.select("ID", "APP", *bundle.features), keep=["ID"])
    fine = F.col("y_pred").isin(bundle.labels) & F.col("confidence").between(0, 1)
    return scored.select("ID", "y_true", F.coalesce(fine, F.lit(False)).alias("scored"), F.lit(len(bundle.features)).alias("inputs"))


@query("evaluate_support", _HELD + "SELECT y_true AS label, count(*) AS support FROM held GROUP BY y_true")
def evaluate_support(spark, sf):
    return evaluate(spark, sf).filter("support > 0").select("label", "support")


@query("evaluate_loss", _HELD + "SELECT count(*) AS rows, true AS finite FROM held")
def evaluate_loss(spark, sf):
    train, valid = features(spark, sf)
    loss = scoring.evaluate_loss(models.train(train, models.decision_tree()), valid)
    fine = (F.col("log_loss") >= 0) & (F.col("log_loss") < 40) & (F.col("correct") <= F.col("rows"))
    return loss.select("rows", fine.alias("finite"))


@query(
    "importance_total",
    "SELECT " + str(len(FEATURE_COLUMNS)) + " AS features, true AS normalized",
)
def importance_total(spark, sf):
    """One importance per feature; they sum to 1, or to 0 for a tree without a split."""
    total = F.round(F.sum("importance"), 6)
    return feature_importance(spark, sf).agg(
        F.countDistinct("feature").cast("int").alias("features"), total.isin(0.0, 1.0).alias("normalized")
    )
