"""Queries: file round trips, manifests and traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import joins, sampling, sequences, stats, tabular
from flowlens.operators.encode import Dictionary
from flowlens.plans import views as v
from flowlens.plans.registry import query, r6
from flowlens.schema import FLOW_SCHEMA
from flowlens.session import scratch_path
from flowlens.sources import readers, writers
from flowlens.sources.cache import FeatureCache

FLOW_FIELDS = [part.split() for part in FLOW_SCHEMA.split(", ")]


def export_layout(flows):
    """Flow rows in the column order of the export files."""
    return flows.select(
        *[
            (F.col(name) if name in flows.columns else F.lit(None)).cast(kind).alias(name)
            for name, kind in FLOW_FIELDS
        ]
    )


def _write_day_files(spark, sf) -> str:
    """One gzip CSV folder per day, named like the daily export files."""
    folder = scratch_path(spark, "csv")
    rows = export_layout(v.flows(spark, sf))
    day = F.date_format(F.to_date(F.substring("TIME_FIRST", 1, 10)), "yyyyMMdd")
    name = F.concat(F.lit("flows-"), day, F.lit(".csv.gz"))
    rows.withColumn("file", name).write.mode("overwrite").option("header", True).option(
        "escape", '"'
    ).option("compression", "gzip").partitionBy("file").csv(folder)
    return folder


_EXPORTED = "ID, BYTES, BYTES_REV, PPI_LEN, round(DURATION, 6) AS DURATION, QUIC_VERSION, PPI_ROUNDTRIPS, APP"


@query("src_csv", f"SELECT {_EXPORTED} FROM flows WHERE APP IS NOT NULL")
def src_csv(spark, sf):
    columns = ["ID", "BYTES", "BYTES_REV", "PPI_LEN", "DURATION", "QUIC_VERSION", "PPI_ROUNDTRIPS"]
    rows = readers.read_day(spark, _write_day_files(spark, sf), columns)
    return rows.withColumn("DURATION", r6(F.col("DURATION")))


@query("scan_recursive", "SELECT ID, BYTES, APP FROM flows")
def scan_recursive(spark, sf):
    folder = scratch_path(spark, "days")
    export_layout(v.flows(spark, sf)).withColumn("day", F.substring("TIME_FIRST", 1, 10)).write.partitionBy(
        "day"
    ).parquet(folder)
    return readers.read_folder(spark, folder, ["ID", "BYTES", "APP"])


@query(
    "etl_csv_parquet",
    f"""
    SELECT {_EXPORTED}, CAST(p.size AS DOUBLE) AS first_size, PHIST_SRC_SIZES_BIN_0 AS bin_0, day
    FROM flows JOIN (SELECT flow_key, flow_no, size FROM ppi WHERE position = 0) p USING (flow_key, flow_no)
    """,
)
def etl_csv_parquet(spark, sf):
    output = scratch_path(spark, "parquet")
    writers.csv_to_parquet(spark, _write_day_files(spark, sf), output)
    parsed = sequences.parse_text_columns(readers.read_flow_parquet(spark, output))
    return parsed.select(
        "ID",
        "BYTES",
        "BYTES_REV",
        "PPI_LEN",
        r6(F.col("DURATION")).alias("DURATION"),
        "QUIC_VERSION",
        "PPI_ROUNDTRIPS",
        "APP",
        F.col("PPI")[2][0].alias("first_size"),
        F.col("PHIST_SRC_SIZES")[0].cast("long").alias("bin_0"),
        F.col("day").cast("string").alias("day"),
    )


@query(
    "etl_rowcounts",
    "SELECT 'flows-' || replace(day, '-', '') || '.parquet' AS source, count(*) AS rows FROM flows GROUP BY day",
)
def etl_rowcounts(spark, sf):
    return writers.csv_to_parquet(spark, _write_day_files(spark, sf), scratch_path(spark, "parquet"))


def _manifest(spark, sf):
    flows = v.flows(spark, sf, stored=True)
    labels = Dictionary.fit(flows, "APP")
    versions = Dictionary.fit(flows, "QUIC_VERSION", first=1)
    samples = writers.write_table(
        sequences.samples(flows, labels, versions, keep=["ID"]), scratch_path(spark, "samples")
    )
    normalization = stats.Normalization.fit(samples, sequences.TABULAR_WIDTH)
    return writers.manifest(samples, "train", labels, versions, normalization, sequences.TABULAR_WIDTH)


@query(
    "manifest",
    """
    SELECT APP AS label, CAST(row_number() OVER (ORDER BY APP) - 1 AS INTEGER) AS label_id, count(*) AS rows
    FROM flows WHERE APP IS NOT NULL GROUP BY APP
    """,
)
def manifest(spark, sf):
    return _manifest(spark, sf).select(
        F.posexplode(F.arrays_zip("index_to_label", "class_counts")).alias("label_id", "entry")
    ).select("entry.index_to_label", "label_id", "entry.class_counts").toDF("label", "label_id", "rows")


@query(
    "src_manifest",
    """
    SELECT 'train' AS split, count(*) AS num_samples, 30 AS seq_len, 45 AS tab_dim,
           CAST(count(DISTINCT APP) AS INTEGER) AS num_classes, 2 AS schema_version,
           round(avg(DURATION), 6) AS mean_duration,
           CAST((SELECT count(DISTINCT QUIC_VERSION) FROM flows) AS INTEGER) AS versions
    FROM flows WHERE APP IS NOT NULL
    """,
)
def src_manifest(spark, sf):
    path = scratch_path(spark, "manifest")
    writers.write_json(_manifest(spark, sf), path)
    return readers.read_manifest(spark, path).select(
        "split",
        "num_samples",
        "seq_len",
        "tab_dim",
        "num_classes",
        "schema_version",
        r6(F.col("normalization.tab_mean")[0]).alias("mean_duration"),
        F.size("version_values").alias("versions"),
    )


@query("manifest_chunks", "SELECT day AS file, count(*) AS num_samples FROM flows WHERE APP IS NOT NULL GROUP BY day")
def manifest_chunks(spark, sf):
    """The chunks a manifest lists: a folder of samples per day with its rows."""
    flows = v.flows(spark, sf, stored=True)
    labels = Dictionary.fit(flows, "APP")
    versions = Dictionary.fit(flows, "QUIC_VERSION", first=1)
    samples = writers.write_table(
        sequences.samples(flows, labels, versions, keep=["ID", "day"]), scratch_path(spark, "chunks"), ["day"]
    )
    normalization = stats.Normalization.fit(samples, sequences.TABULAR_WIDTH)
    chunks = samples.groupBy(F.col("day").cast("string").alias("file")).agg(F.count(F.lit(1)).alias("rows"))
    path = scratch_path(spark, "manifest")
    writers.write_json(writers.manifest(samples, "train", labels, versions, normalization, sequences.TABULAR_WIDTH, chunks), path)
    return readers.read_manifest(spark, path).select(F.inline("chunks"))


@query(
    "src_service_map",
    """
    , map AS (SELECT DISTINCT event_type AS APP, CASE WHEN event_type IN ('click', 'view') THEN 'north' ELSE 'south' END AS provider
              FROM packets WHERE event_type <> 'error')
    SELECT provider, count(*) AS flows FROM flows LEFT JOIN map USING (APP) GROUP BY provider
    """,
)
def src_service_map(spark, sf):
    """Flows per provider, looked up in a service map file; services the file lacks have none."""
    known = v.packets(spark, sf).filter("event_type <> 'error'").select(F.col("event_type").alias("APP")).distinct()
    provider = F.when(F.col("APP").isin("click", "view"), "north").otherwise("south")
    path = scratch_path(spark, "servicemap")
    known.withColumn("provider", provider).coalesce(1).write.option("header", True).csv(path)
    flows = v.flows(spark, sf, text=False).select("APP")
    joined = joins.lookup(flows, readers.read_service_map(spark, path), "APP")
    return joined.groupBy("provider").agg(F.count(F.lit(1)).alias("flows"))


@query(
    "src_statistics",
    """
    SELECT day, APP, seen, coalesce(saved, 0) AS saved
    FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS APP, count(*) AS seen FROM packets GROUP BY ALL)
    LEFT JOIN (SELECT day, APP, count(*) AS saved FROM flows GROUP BY ALL) USING (day, APP)
    """,
)
def src_statistics(spark, sf):
    """Saved and seen counts per day and service, from the statistics files that go with the flow files."""
    seen = v.packets(spark, sf).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("APP")).agg(
        F.count(F.lit(1)).alias("seen")
    )
    path = scratch_path(spark, "stats")
    # One JSON list per day, like the files that come with the data; it is as long as there are services.
    listed = seen.groupBy("day").agg(F.to_json(F.collect_list(F.struct("APP", "seen"))).alias("value"))
    listed.write.partitionBy("day").text(path)
    read = readers.read_statistics(spark, path, "APP string, seen long, day string")
    flows = v.flows(spark, sf, text=False).groupBy(F.col("day").cast("string").alias("day"), "APP").agg(F.count(F.lit(1)).alias("saved"))
    return read.join(flows, ["day", "APP"], "left").select("day", "APP", "seen", F.coalesce("saved", F.lit(0)).alias("saved"))


@query("feature_cache", "SELECT ID, APP, CAST(BYTES + BYTES_REV AS DOUBLE) AS TOTAL_BYTES, true AS hit FROM flows WHERE APP IS NOT NULL")
def feature_cache(spark, sf):
    """Features of a day folder from the cache, asked for a second time."""
    source = scratch_path(spark, "source")
    export_layout(v.flows(spark, sf)).write.parquet(source)
    cache = FeatureCache(spark, scratch_path(spark, "cache"))
    build = lambda path: tabular.derived_only(readers.read_flow_parquet(spark, path).filter("APP IS NOT NULL"), ["TOTAL_BYTES"], keep=["ID", "APP"])
    cache.get(source, ["TOTAL_BYTES"], build)
    table, hit = cache.get(source, ["TOTAL_BYTES"], build)
    return table.withColumn("hit", F.lit(hit))


@query(
    "src_traces",
    """
    , picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY APP ORDER BY first_us, head_id) AS rank
                                FROM flows WHERE APP IN ('view', 'click', 'error')) WHERE rank <= 12)
    SELECT APP AS ground_truth, count(*) AS traces, CAST(sum(packet_bytes) AS DOUBLE) AS bytes,
           round(sum(DURATION), 6) AS seconds
    FROM picked JOIN (SELECT flow_key, flow_no, sum(size) AS packet_bytes FROM ppi GROUP BY flow_key, flow_no)
         USING (flow_key, flow_no)
    GROUP BY APP
    """,
)
def src_traces(spark, sf):
    flows = v.flows(spark, sf, stored=True)
    picked = sampling.pick_traces(flows, "APP", ["view", "click", "error"], 12, ["first_us", "head_id"])
    versions = Dictionary.fit(flows, "QUIC_VERSION", first=1)
    samples = sequences.samples(picked, None, versions, keep=["APP"])
    path = scratch_path(spark, "traces")
    writers.write_traces(
        samples.select(F.col("APP").alias("ground_truth"), "sequences", "tabular", "version_idx"), path
    )
    size = F.aggregate(F.col("sequences")[2], F.lit(0.0), lambda s, x: s + x)
    return readers.read_traces(spark, path).groupBy("ground_truth").agg(
        F.count(F.lit(1)).alias("traces"),
        F.sum(size).alias("bytes"),
        r6(F.sum(F.col("tabular")[0])).alias("seconds"),
    )
