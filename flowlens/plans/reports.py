"""Queries: dictionaries, lookups, counts, metrics, samples and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import census, encode, joins, metrics, sampling, stats
from flowlens.operators.encode import Dictionary
from flowlens.plans import views as v
from flowlens.plans.registry import query, r6, rounded

TRAIN_DAYS_HELD = 0.9
_DICT = """
, dict AS (SELECT SERVICE, CAST(row_number() OVER (ORDER BY SERVICE) - 1 AS INTEGER) AS idx
           FROM (SELECT DISTINCT SERVICE FROM {source}))
"""
_TRAIN_DICT = _DICT.format(source="train")
_SCORE = f"(head_id % {v.SCORE_RANGE}) * {v.SCORE_FACTOR} % {v.SCORE_RANGE}"


def _split(spark, sf):
    return _split_of(v.services(spark, sf, stored=True))


def _split_of(services):
    return sampling.time_split(services, "day", TRAIN_DAYS_HELD)


# Dictionaries ----------------------------------------------------------------------


@query("label_dictionary", _DICT.format(source="services") + "SELECT SERVICE AS value, idx AS index FROM dict")
def label_dictionary(spark, sf):
    return Dictionary.fit(v.services(spark, sf), "SERVICE").frame


@query("known_label_filter", "SELECT ID, SERVICE FROM valid WHERE SERVICE IN (SELECT SERVICE FROM train)")
def known_label_filter(spark, sf):
    train, valid = _split(spark, sf)
    return Dictionary.fit(train, "SERVICE").keep_known(valid, "SERVICE").select("ID", "SERVICE")


@query(
    "label_overlap",
    """
    SELECT SERVICE, count(*) AS flows FROM valid
    WHERE SERVICE IN (SELECT SERVICE FROM train INTERSECT SELECT SERVICE FROM valid) GROUP BY SERVICE
    """,
)
def label_overlap(spark, sf):
    train, valid = _split(spark, sf)
    kept = encode.overlap(valid, train, "SERVICE")
    return kept.groupBy("SERVICE").agg(F.count(F.lit(1)).alias("flows"))


@query("shared_labels", "SELECT SERVICE FROM train INTERSECT SELECT SERVICE FROM valid")
def shared_labels(spark, sf):
    return encode.shared_labels(*_split(spark, sf), "SERVICE")


@query("unseen_labels", "SELECT DISTINCT SERVICE FROM valid WHERE SERVICE NOT IN (SELECT SERVICE FROM train)")
def unseen_labels(spark, sf):
    train, valid = _split(spark, sf)
    return Dictionary.fit(train, "SERVICE").unseen(valid, "SERVICE")


@query("label_encode", _TRAIN_DICT + "SELECT ID, SERVICE, idx AS label_id FROM valid JOIN dict USING (SERVICE)")
def label_encode(spark, sf):
    train, valid = _split(spark, sf)
    labels = Dictionary.fit(train, "SERVICE")
    return labels.encode(valid.select("ID", "SERVICE"), "SERVICE", "label_id")


@query(
    "label_decode",
    _TRAIN_DICT
    + """
    SELECT ID, CAST(flow_key % 90 AS INTEGER) AS label_id, dict.SERVICE AS label
    FROM flows LEFT JOIN dict ON flow_key % 90 = idx
    """,
)
def label_decode(spark, sf):
    flows = v.flows(spark, sf, text=False, stored=True)
    labels = Dictionary.fit(_split_of(v.services_of(flows))[0], "SERVICE")
    guesses = flows.select("ID", (F.col("flow_key") % 90).cast("int").alias("label_id"))
    return labels.decode(guesses, "label_id", "label")


_VERSIONS = """
, held AS (SELECT ID, QUIC_VERSION * 100 + DST_ASN AS VERSION FROM valid),
vdict AS (SELECT VERSION, CAST(row_number() OVER (ORDER BY VERSION) AS INTEGER) AS idx
          FROM (SELECT DISTINCT QUIC_VERSION * 100 + DST_ASN AS VERSION FROM train WHERE QUIC_VERSION IS NOT NULL)),
indexed AS (SELECT ID, VERSION, coalesce(idx, 0) AS version_idx FROM held LEFT JOIN vdict USING (VERSION))
"""


def _indexed(spark, sf):
    train, valid = _split(spark, sf)
    versions = Dictionary.fit(train, "VERSION", first=1)
    return versions, versions.encode(valid.select("ID", "VERSION"), "VERSION", "version_idx", missing=0)


@query("version_index", _VERSIONS + "SELECT * FROM indexed")
def version_index(spark, sf):
    return _indexed(spark, sf)[1]


@query(
    "version_onehot",
    _VERSIONS
    + """
    SELECT ID, version_idx AS hot_at, CAST(1 AS DOUBLE) AS total,
           CAST((SELECT count(*) + 1 FROM vdict) AS INTEGER) AS width
    FROM indexed
    """,
)
def version_onehot(spark, sf):
    versions, rows = _indexed(spark, sf)
    hot = encode.one_hot(rows, "version_idx", versions.frame.count() + 1, "slots")
    return hot.select(
        "ID",
        (F.array_position("slots", F.lit(1.0)) - 1).cast("int").alias("hot_at"),
        F.aggregate("slots", F.lit(0.0), lambda s, x: s + x).alias("total"),
        F.size("slots").alias("width"),
    )


_PROVIDERS = ", service_map(APP, provider) AS (VALUES " + ", ".join(f"('{a}', '{p}')" for a, p in v.PROVIDERS) + ") "


@query("provider_join", _PROVIDERS + "SELECT ID, APP, provider FROM flows LEFT JOIN service_map USING (APP)")
def provider_join(spark, sf):
    flows = v.flows(spark, sf, text=False).select("ID", "APP")
    return joins.lookup(flows, v.service_map(spark), "APP").select("ID", "APP", "provider")


# Counts ----------------------------------------------------------------------------


@query("class_counts", "SELECT APP, count(*) AS rows FROM flows WHERE APP IS NOT NULL GROUP BY APP")
def class_counts(spark, sf):
    return stats.class_counts(v.flows(spark, sf, text=False), "APP")


@query("distinct_versions", "SELECT DISTINCT QUIC_VERSION FROM flows WHERE QUIC_VERSION IS NOT NULL")
def distinct_versions(spark, sf):
    return stats.distinct_values(v.flows(spark, sf, text=False), "QUIC_VERSION")


@query("row_count", "SELECT count(*) AS rows FROM flows")
def row_count(spark, sf):
    return v.flows(spark, sf, text=False).agg(F.count(F.lit(1)).alias("rows"))


@query("partition_profile")
def partition_profile(spark, sf):
    return stats.partition_profile(v.flows(spark, sf).repartition("flow_key", "flow_no"))


@query(
    "class_weights",
    _DICT.format(source="services")
    + """
    , counts AS (SELECT SERVICE, count(*) AS rows FROM train GROUP BY SERVICE)
    SELECT SERVICE, idx AS index, coalesce(rows, 0) AS rows,
           round((SELECT sum(rows) FROM counts) / ((SELECT count(*) FROM dict) * greatest(coalesce(rows, 0), 1)), 6) AS weight
    FROM dict LEFT JOIN counts USING (SERVICE)
    """,
)
def class_weights(spark, sf):
    services = v.services(spark, sf, stored=True)
    labels = Dictionary.fit(services, "SERVICE")
    return rounded(stats.class_weights(_split_of(services)[0], "SERVICE", labels), "weight")


@query(
    "service_rollup",
    """
    SELECT strftime(date_trunc('week', first_ts), '%Y-%m-%d') AS week, day, APP, GROUPING(week, day, APP) AS level, count(*) AS flows
    FROM flows GROUP BY ROLLUP (week, day, APP)
    """,
)
def service_rollup(spark, sf):
    flows = v.flows(spark, sf, text=False).select(
        F.date_format(F.date_trunc("week", "TIME_FIRST"), "yyyy-MM-dd").alias("week"), F.col("day").cast("string").alias("day"), "APP"
    )
    return census.service_rollup(flows, "week", "day", "APP")


_COUNTED = ["QUIC_VERSION", "QUIC_USER_AGENT", "DST_ASN", "APP", "CATEGORY"]


@query(
    "value_counts",
    ", typed AS (SELECT *, CASE WHEN APP IN ('click', 'view', 'signup') THEN 'interactive' ELSE 'transfer' END AS CATEGORY FROM flows) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS field, CAST({c} AS VARCHAR) AS value, count(*) AS rows FROM typed GROUP BY {c}" for c in _COUNTED
    ),
)
def value_counts(spark, sf):
    return census.value_counts(v.flows(spark, sf, text=False), _COUNTED)


@query(
    "sampling_ratio",
    """
    SELECT event_type AS APP, seen, coalesce(saved, 0) AS saved, round(coalesce(saved, 0) / seen, 6) AS ratio,
           round(seen / saved, 6) AS weight
    FROM (SELECT event_type, count(*) AS seen FROM packets GROUP BY event_type) s
    LEFT JOIN (SELECT APP, count(*) AS saved FROM flows GROUP BY APP) f ON APP = event_type
    """,
)
def sampling_ratio(spark, sf):
    seen = v.packets(spark, sf).groupBy(F.col("event_type").alias("APP")).agg(F.count(F.lit(1)).alias("seen"))
    ratios = census.sampling_ratio(v.flows(spark, sf, text=False), seen, "APP")
    return rounded(ratios, "ratio", "weight")


@query(
    "restored_counts",
    """
    , w AS (SELECT event_type AS APP, count(*) AS seen FROM packets GROUP BY event_type),
    s AS (SELECT APP, count(*) AS saved FROM flows GROUP BY APP)
    SELECT APP, count(*) AS flows, round(sum(seen / saved), 6) AS restored
    FROM flows LEFT JOIN w USING (APP) LEFT JOIN s USING (APP) GROUP BY APP
    """,
)
def restored_counts(spark, sf):
    flows = v.flows(spark, sf, text=False, stored=True).select("APP")
    seen = v.packets(spark, sf).groupBy(F.col("event_type").alias("APP")).agg(F.count(F.lit(1)).alias("seen"))
    weighted = census.with_service_weight(flows, census.sampling_ratio(flows, seen, "APP"), "APP")
    return weighted.groupBy("APP").agg(
        F.count(F.lit(1)).alias("flows"), r6(F.sum("weight")).alias("restored")
    )


# Metrics ---------------------------------------------------------------------------


@query("confusion", "SELECT y_true, y_pred, count(*) AS rows FROM predictions GROUP BY y_true, y_pred")
def confusion(spark, sf):
    return metrics.confusion(v.predictions(spark, sf))


_TYPES = ["click", "error", "purchase", "signup", "view"]


@query(
    "confusion_matrix",
    "SELECT y_true, "
    + ", ".join(f"count(*) FILTER (WHERE y_pred = '{t}') AS {t}" for t in _TYPES)
    + " FROM predictions GROUP BY y_true",
)
def confusion_matrix(spark, sf):
    predictions = v.predictions(spark, sf, stored=True)
    guessed = Dictionary.fit(predictions.select("y_pred"), "y_pred").values()
    return metrics.confusion_matrix(predictions, guessed)


@query(
    "accuracy",
    "SELECT count(*) AS rows, round(avg(CASE WHEN y_true = y_pred THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM predictions",
)
def accuracy(spark, sf):
    return rounded(metrics.accuracy(v.predictions(spark, sf)), "accuracy")


@query("macro_f1", "SELECT count(*) AS classes, round(avg(f1), 6) AS macro_f1 FROM report")
def macro_f1(spark, sf):
    return rounded(metrics.macro_f1(v.predictions(spark, sf)), "macro_f1")


@query(
    "macro_f1_allclass",
    """
    , classes AS (SELECT DISTINCT y_true AS label FROM predictions UNION SELECT 'absent'),
    joined AS (SELECT label, coalesce(correct, 0) / (coalesce(guessed, 0) + 1e-9::DOUBLE) AS p,
                      coalesce(correct, 0) / (coalesce(support, 0) + 1e-9::DOUBLE) AS r
               FROM classes LEFT JOIN totals USING (label))
    SELECT count(*) AS classes, round(avg(2 * p * r / (p + r + 1e-9::DOUBLE)), 6) AS macro_f1 FROM joined
    """,
)
def macro_f1_allclass(spark, sf):
    predictions = v.predictions(spark, sf, stored=True)
    names = Dictionary.fit(predictions, "y_true").values()
    labels = Dictionary.of_values(spark, sorted([*names, "absent"]))
    return rounded(metrics.macro_f1_all(predictions, labels), "macro_f1")


@query(
    "class_report",
    """
    SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support, correct
    FROM report
    """,
)
def class_report(spark, sf):
    return rounded(metrics.class_report(v.predictions(spark, sf)), "precision", "recall", "f1")


@query(
    "class_accuracy",
    """
    SELECT label, support, correct, round(recall, 6) AS accuracy, round(f1, 6) AS f1 FROM report
    WHERE support > 0 ORDER BY recall DESC, label
    """,
)
def class_accuracy(spark, sf):
    return rounded(metrics.class_accuracy(v.predictions(spark, sf)), "accuracy", "f1")


@query(
    "top10_support",
    """
    , pairs AS (SELECT SERVICE AS y_true, y_pred || '-' || DST_ASN AS y_pred FROM services),
    t AS (SELECT y_true AS label, count(*) AS support, count(*) FILTER (WHERE y_true = y_pred) AS correct
          FROM pairs GROUP BY y_true),
    g AS (SELECT y_pred AS label, count(*) AS guessed FROM pairs GROUP BY y_pred)
    SELECT label, round(coalesce(correct / guessed, 0), 6) AS precision, round(correct / support, 6) AS recall,
           round(2 * correct / (coalesce(guessed, 0) + support), 6) AS f1, support
    FROM t LEFT JOIN g USING (label) ORDER BY support DESC, label LIMIT 10
    """,
)
def top10_support(spark, sf):
    pairs = v.services(spark, sf).select(
        F.col("SERVICE").alias("y_true"), F.concat_ws("-", "y_pred", "DST_ASN").alias("y_pred")
    )
    return rounded(metrics.top_by_support(pairs), "precision", "recall", "f1")


@query(
    "log_loss",
    """
    SELECT count(*) AS rows, count(*) FILTER (WHERE y_true = y_pred) AS correct,
           round(sum(-ln(p_true)), 6) AS loss_sum, round(avg(-ln(p_true)), 6) AS log_loss
    FROM predictions
    """,
)
def log_loss(spark, sf):
    return rounded(metrics.log_loss(v.predictions(spark, sf), F.col("p_true")), "loss_sum", "log_loss")


@query(
    "provider_accuracy",
    _PROVIDERS
    + """
    SELECT provider, count(*) AS rows,
           round(avg(CASE WHEN y_true = y_pred THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy
    FROM predictions LEFT JOIN service_map ON APP = y_true GROUP BY provider
    """,
)
def provider_accuracy(spark, sf):
    providers = v.service_map(spark).withColumnRenamed("APP", "y_true")
    joined = joins.lookup(v.predictions(spark, sf), providers, "y_true")
    return rounded(metrics.grouped_accuracy(joined, "provider"), "accuracy")


@query(
    "running_accuracy",
    """
    SELECT day, rows, correct, round(correct / rows, 6) AS accuracy FROM (
      SELECT day, row_number() OVER w AS rows,
             CAST(sum(CASE WHEN y_true = y_pred THEN 1 ELSE 0 END) OVER w AS BIGINT) AS correct
      FROM predictions WINDOW w AS (PARTITION BY day ORDER BY first_us, head_id))
    WHERE rows % 10 = 0
    """,
)
def running_accuracy(spark, sf):
    scored = v.predictions(spark, sf).withColumn("day", F.col("day").cast("string"))
    return rounded(metrics.running_accuracy(scored, "day", ["first_us", "head_id"], 10), "accuracy")


@query(
    "running_loss",
    """
    SELECT day, rows, correct, round(correct / rows, 6) AS accuracy, round(loss / rows, 6) AS loss FROM (
      SELECT day, row_number() OVER w AS rows, sum(-ln(p_true)) OVER w AS loss,
             CAST(sum(CASE WHEN y_true = y_pred THEN 1 ELSE 0 END) OVER w AS BIGINT) AS correct
      FROM predictions WINDOW w AS (PARTITION BY day ORDER BY first_us, head_id))
    WHERE rows % 10 = 0
    """,
)
def running_loss(spark, sf):
    scored = v.predictions(spark, sf).withColumn("day", F.col("day").cast("string"))
    running = metrics.running_accuracy(scored, "day", ["first_us", "head_id"], 10, probability=F.col("p_true"))
    return rounded(running, "accuracy", "loss")


@query(
    "argmax_conf",
    """
    SELECT ID, CAST(CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS INTEGER) AS label_id,
           greatest(a, b, c) AS confidence
    FROM (SELECT ID, BYTES % 7 / 10.0::DOUBLE AS a, BYTES_REV % 7 / 10.0::DOUBLE AS b,
                 (PACKETS + PACKETS_REV) % 7 / 10.0::DOUBLE AS c FROM flows)
    """,
)
def argmax_conf(spark, sf):
    parts = [F.col("BYTES"), F.col("BYTES_REV"), F.col("PACKETS") + F.col("PACKETS_REV")]
    index, best = metrics.argmax(F.col("p"))
    rows = v.flows(spark, sf, text=False).select("ID", F.array(*[p % 7 / 10.0 for p in parts]).alias("p"))
    return rows.select("ID", index.alias("label_id"), best.alias("confidence"))


# Samples and splits ----------------------------------------------------------------


def _scored(spark, sf, stored=False):
    return v.flows(spark, sf, text=False, stored=stored), v.score_of("head_id")


@query("sample_exact", f"SELECT ID, head_id FROM flows ORDER BY {_SCORE}, head_id LIMIT 300")
def sample_exact(spark, sf):
    flows, score = _scored(spark, sf, stored=True)
    return sampling.sample_rows(flows, 300, "head_id", score=score).select("ID", "head_id")


@query("sample_fraction", f"SELECT ID FROM flows WHERE {_SCORE} < {v.SCORE_RANGE // 4}")
def sample_fraction(spark, sf):
    flows, score = _scored(spark, sf)
    return sampling.sample_fraction(flows, 0.25, "head_id", score=score).select("ID")


@query(
    "stratified_split",
    f"""
    SELECT ID, APP, row_number() OVER (PARTITION BY APP ORDER BY {_SCORE}, head_id)
                    <= round(0.2 * count(*) OVER (PARTITION BY APP)) AS is_validation
    FROM flows WHERE APP IS NOT NULL
    """,
)
def stratified_split(spark, sf):
    flows, score = _scored(spark, sf, stored=True)
    known = flows.filter(F.col("APP").isNotNull())
    return sampling.stratified_split(known, "APP", "head_id", 0.2, score=score).select("ID", "APP", "is_validation")


@query("time_split", "SELECT ID, day, 'train' AS split FROM train UNION ALL SELECT ID, day, 'valid' FROM valid")
def time_split(spark, sf):
    train, valid = _split(spark, sf)
    both = [part.select("ID", F.col("day").cast("string").alias("day"), F.lit(name).alias("split"))
            for part, name in ((train, "train"), (valid, "valid"))]
    return sampling.concat_days(*both)


@query(
    "union_days",
    """
    SELECT ID, BYTES, NULL::BIGINT AS PACKETS FROM train UNION ALL SELECT ID, NULL, PACKETS FROM valid
    """,
)
def union_days(spark, sf):
    train, valid = _split(spark, sf)
    return sampling.concat_days(train.select("ID", "BYTES"), valid.select("ID", "PACKETS"))


@query("epoch_shuffle", f"SELECT ID, head_id FROM flows ORDER BY {_SCORE}, head_id")
def epoch_shuffle(spark, sf):
    flows, score = _scored(spark, sf)
    return sampling.epoch_order(flows.select("ID", "head_id"), "head_id", epoch=0, score=score)
