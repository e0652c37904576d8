"""Packet, flow and prediction views derived from the `events` table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from flowlens.operators import packets as pk
from flowlens.schema import HISTOGRAM_NAMES
from flowlens.session import scratch_path
from flowlens.sources.writers import write_table

HOUR_US = 3_600_000_000
IDLE_US = 24 * HOUR_US
ACTIVE_US = 72 * HOUR_US
# One unit of inter-packet time in the derived data is a minute.
UNIT_US = 60_000_000
FORWARD_TYPES = ["click", "view", "signup"]
PROVIDERS = [("click", "north"), ("view", "north"), ("signup", "south"), ("purchase", "south")]
SCORE_RANGE = 4294967296
SCORE_FACTOR = 1103515245

# Columns of a flow's first and last packet.
FIRST = ["first_type", "QUIC_VERSION", "k", "head_id"]
LAST = ["y_pred", "last_size"]


# Declared layouts spare the footer scan that schema inference starts.
LAYOUTS = {
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read.schema(LAYOUTS[name]) if name in LAYOUTS else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def events_to_packets(events: DataFrame) -> DataFrame:
    """Packet columns of an event table; works on batch and streaming tables alike."""
    user = F.col("user_id")
    k = F.get_json_object("props", "$.k").cast("int")
    ts = F.col("ts").cast("timestamp")
    known = events.select(
        F.col("event_id").alias("packet_id"),
        user.alias("flow_key"),
        ts.alias("ts"),
        F.unix_micros(ts).alias("ts_us"),
        "event_type",
        F.when(F.col("event_type").isin(FORWARD_TYPES), 1).otherwise(-1).alias("direction"),
        F.floor(F.col("value") * 4).alias("size"),
        k.alias("k"),
    )
    forward = F.col("direction") == 1
    client, server = F.concat(F.lit("10.0.0."), F.col("flow_key")), F.concat(F.lit("192.0.2."), F.col("k") % 8)
    client_port = (F.col("flow_key") + 1024).cast("int")
    server_port = F.when(F.col("k") % 7 == 0, 80).otherwise(443)
    byte = F.unhex(F.lpad(F.hex(F.col("k") * 2), 2, "0"))
    return known.withColumns(
        {
            "version": F.when(F.col("k") % 10 != 0, (F.col("k") % 4).cast("long")),
            "src": F.when(forward, client).otherwise(server),
            "dst": F.when(forward, server).otherwise(client),
            "sport": F.when(forward, client_port).otherwise(server_port),
            "dport": F.when(forward, server_port).otherwise(client_port),
            "protocol": F.when(F.col("k") % 13 == 0, 6).otherwise(17),
            "payload": F.when(F.col("k") % 10 == 9, F.lit(b"")).otherwise(byte),
        }
    )


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_to_packets(table(spark, sf_dir, "events"))


def score_of(id_column: str) -> Column:
    """Multiplicative hash of an id in [0, 2^32) that any SQL dialect can compute."""
    return F.col(id_column) % SCORE_RANGE * SCORE_FACTOR % SCORE_RANGE


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _label(packets(spark, sf_dir))


def _label(rows: DataFrame) -> DataFrame:
    return pk.label_flows(rows, ["flow_key"], IDLE_US, ACTIVE_US, UNIT_US)


def flows(spark: SparkSession, sf_dir: str, text: bool = True, stored: bool = False) -> DataFrame:
    """Flow table; with `text` sequences, histograms and times are in their stored text form.

    Queries that use the flows more than once ask for them `stored`: assembled and written once, so
    dictionaries, splits and statistics scan the narrow table by column.
    """
    source = packets(spark, sf_dir)
    rows = _label(source)
    user = F.col("flow_key")
    rows = rows.withColumns(
        {
            "first_type": F.col("event_type"),
            "QUIC_VERSION": F.col("version"),
            "head_id": F.col("packet_id"),
            "y_pred": F.col("event_type"),
            "last_size": F.col("size"),
        }
    )
    end = source.agg(F.max("ts_us")).scalar()
    result = pk.assemble_flows(rows, ["flow_key"], IDLE_US, end, FIRST, LAST)
    app = F.when(user % 37 != 0, F.col("first_type"))
    result = result.withColumns(
        {
            "ID": F.concat_ws("-", "flow_key", "flow_no"),
            "APP": app,
            "SRC_IP": F.concat(F.lit("10.0.0."), user),
            "DST_IP": F.concat(F.lit("192.0.2."), F.col("k") % 8),
            "QUIC_USER_AGENT": F.when(F.col("k") % 3 == 0, F.concat(F.lit("agent-"), F.col("k") % 5)),
            "p_true": (F.col("last_size") % 97 + 1) / 100.0,
            "DST_ASN": (user % 16).cast("int"),
            "SRC_PORT": (user + 1024).cast("int"),
            "DST_PORT": F.lit(443),
            "PROTOCOL": F.lit(17),
            "CATEGORY": F.when(app.isin(FORWARD_TYPES), "interactive").otherwise("transfer"),
            "day": F.to_date("TIME_FIRST"),
        }
    )
    if stored:
        result = write_table(result, scratch_path(spark, "flows"))
    if not text:
        return result
    stored = "yyyy-MM-dd'T'HH-mm-ss.SSSSSS"
    return result.withColumns(
        {
            "PPI": F.to_json("PPI"),
            **{h: F.to_json(h) for h in HISTOGRAM_NAMES},
            "TIME_FIRST": F.date_format("TIME_FIRST", stored),
            "TIME_LAST": F.date_format("TIME_LAST", stored),
        }
    )


def predictions(spark: SparkSession, sf_dir: str, stored: bool = False) -> DataFrame:
    """True label: first event type of a flow; predicted label: its last event type."""
    return flows(spark, sf_dir, text=False, stored=stored).filter(F.col("APP").isNotNull()).select(
        "flow_key", "flow_no", "head_id", "first_us", "day", F.col("APP").alias("y_true"), "y_pred", "p_true"
    )


def service_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROVIDERS, T.StructType.fromDDL("APP string, provider string"))


def services(spark: SparkSession, sf_dir: str, stored: bool = False) -> DataFrame:
    return services_of(flows(spark, sf_dir, text=False, stored=stored))


def services_of(table: DataFrame) -> DataFrame:
    """Labelled flows with a finer label, so that days differ in the labels they hold."""
    return (
        table.filter(F.col("APP").isNotNull())
        .withColumns(
            {
                "SERVICE": F.concat_ws("-", "APP", "DST_ASN"),
                "VERSION": F.col("QUIC_VERSION") * 100 + F.col("DST_ASN"),
            }
        )
    )
