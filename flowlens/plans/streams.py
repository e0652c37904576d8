"""Queries: streams over the packet table, run to completion."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import models, packets as pk
from flowlens.operators.scoring import score
from flowlens.plans import learning, views as v
from flowlens.plans.registry import query
from flowlens.schema import SEQUENCE_LENGTH
from flowlens.session import scratch_path
from flowlens.sources.writers import write_table
from flowlens.streaming import batches, packets as st
from flowlens.streaming.replay import Replay

DELAY = "1 hour"
DELAY_US = v.HOUR_US
SPLIT = "2024-01-16"
# Packets of a micro-batch, about.
FILE_ROWS = 2_000_000
# Bytes of a row group of such a file, and of the part of it that a task reads at least.
GROUP_BYTES = 1 << 20


def _packets(spark, sf):
    events = st.read_stream(spark, sf, v.LAYOUTS["events"], pattern="events.parquet")
    return v.events_to_packets(events)


@query(
    "st_packets",
    "SELECT packet_id, src, dst, sport, dport FROM packets WHERE protocol = 17 AND 443 IN (sport, dport)",
)
def st_packets(spark, sf):
    stream = pk.quic_packets(_packets(spark, sf)).select("packet_id", "src", "dst", "sport", "dport")
    return st.run_once(stream)


_WINDOWS = f"""
    , held AS (SELECT *, lag(ts_us) OVER (PARTITION BY flow_key ORDER BY ts_us, packet_id) AS before_us FROM {{source}}),
    spells AS (SELECT *, sum(CASE WHEN {{restart}} THEN 1 ELSE 0 END)
                         OVER (PARTITION BY flow_key ORDER BY ts_us, packet_id) AS spell FROM held),
    runs AS (SELECT *, row_number() OVER (PARTITION BY flow_key, spell ORDER BY ts_us, packet_id) - 1 AS nth FROM spells),
    windows AS (
      SELECT flow_key, count(*) AS n, min(ts_us) AS first_us, max(ts_us) AS last_us, CAST(sum(size) AS DOUBLE) AS bytes,
             CAST(sum(CASE WHEN nth % {SEQUENCE_LENGTH} = 0 THEN 0 ELSE (ts_us - before_us) // {v.UNIT_US} END) AS DOUBLE) AS pause
      FROM runs GROUP BY flow_key, spell, nth // {SEQUENCE_LENGTH})
"""


def _windows_sql(source: str, idle_us: int | None = None) -> str:
    """Full windows of a packet table; a silence longer than `idle_us` starts over."""
    restart = f"before_us IS NULL OR ts_us - before_us > {idle_us}" if idle_us else "before_us IS NULL"
    return _WINDOWS.format(source=source, restart=restart) + f"""
    SELECT flow_key, row_number() OVER (PARTITION BY flow_key ORDER BY first_us) - 1 AS window_no,
           first_us, last_us, bytes, pause
    FROM windows WHERE n = {SEQUENCE_LENGTH}
    """


def _summarized(windows):
    def total(i):
        return F.aggregate(F.get("sequence", F.lit(i)), F.lit(0.0), lambda s, x: s + x)

    return windows.select(
        "flow_key", "window_no", "first_us", "last_us", total(2).alias("bytes"), total(0).alias("pause")
    )


def _arrivals(spark, sf):
    """The packets as a stream of files in the order of time, one file a micro-batch.

    Files hold about FILE_ROWS packets, at least five files are made. They hold many small row groups,
    so the tasks of a micro-batch share its one file.
    """
    events = v.table(spark, sf, "events")
    files = max(5, -(-events.count() // FILE_ROWS))
    folder = scratch_path(spark, "arrivals")
    ranked = events.repartitionByRange(files, "ts").withColumn("part", F.spark_partition_id())
    stored = write_table(ranked, scratch_path(spark, "ranked"), ["part"])
    # Files are taken in the order they were written in; parts of one job may get any order.
    for part in range(files):
        stored.filter(F.col("part") == part).drop("part").coalesce(1).write.mode("append").option(
            "parquet.block.size", GROUP_BYTES
        ).parquet(folder)
    return v.events_to_packets(st.read_stream(spark, folder, v.LAYOUTS["events"], files_per_trigger=1))


@query("st_count_window", _windows_sql("packets"))
def st_count_window(spark, sf):
    """Count windows over several micro-batches; what a batch leaves is kept as a table."""
    windows = batches.CountWindows(spark, scratch_path(spark, "windows"), ["flow_key"], unit_us=v.UNIT_US)
    st.run_batches(_arrivals(spark, sf), windows.handle)
    return _summarized(windows.windows())


_EXPORT_SQL = """
    SELECT flow_key, first_us, last_us, PACKETS, PACKETS_REV, BYTES, BYTES_REV,
           CASE WHEN FLOW_ENDREASON_IDLE = 1 THEN 'idle' WHEN FLOW_ENDREASON_ACTIVE = 1 THEN 'active' ELSE 'other' END AS end_reason
    FROM flows
"""


@query("st_flows", _EXPORT_SQL)
def st_flows(spark, sf):
    """Flows of a stream with idle and active timeouts and the reason of their end."""
    export = batches.FlowExport(spark, scratch_path(spark, "export"), ["flow_key"], v.IDLE_US, v.ACTIVE_US, DELAY_US)
    st.run_batches(_arrivals(spark, sf), export.handle)
    return export.close()


DAMAGED = 11


@query(
    "st_window_score",
    _WINDOWS.format(source="packets", restart="before_us IS NULL")
    + f"""
    SELECT flow_key, window_no, CASE WHEN flow_key % {DAMAGED} = 0 THEN 'API_ERROR' ELSE 'scored' END AS outcome,
           CASE WHEN flow_key % {DAMAGED} = 0 THEN 0 ELSE bytes END AS bytes
    FROM (SELECT flow_key, row_number() OVER (PARTITION BY flow_key ORDER BY first_us) - 1 AS window_no, bytes
          FROM windows WHERE n = {SEQUENCE_LENGTH})
    """,
)
def st_window_score(spark, sf):
    """Windows of a stream scored by a tree; requests that lost a channel become error rows.

    The tree learns from the flows' sequences whether most bytes go up.
    """
    model = _sequence_model(spark, sf)

    def request(windows):
        whole = F.col("sequence")
        return windows.select(
            "flow_key", "window_no", F.when(F.col("flow_key") % DAMAGED == 0, F.slice(whole, 1, 2)).otherwise(whole).alias("sequences")
        )

    def answer(requests):
        scored = score(model, _window_features(requests, "sequences"), keep=["flow_key", "window_no", "bytes"])
        fine = F.col("y_pred").isin("up", "down") & F.col("confidence").between(0, 1)
        return scored.select("flow_key", "window_no", F.when(fine, "scored").otherwise("odd").alias("outcome"), "bytes")

    windows = batches.CountWindows(spark, scratch_path(spark, "windows"), ["flow_key"], unit_us=v.UNIT_US)
    scores = batches.WindowScores(windows, request, answer)
    st.run_batches(_arrivals(spark, sf), scores.handle)
    rejected = scores.table("errors").select("flow_key", "window_no", F.col("label").alias("outcome"), F.lit(0.0).alias("bytes"))
    return scores.table("scores").unionByName(rejected)


_WINDOW_FEATURES = ["bytes", "pause", "forward"]


def _window_features(rows, sequence):
    total = lambda i: F.aggregate(F.get(sequence, F.lit(i)), F.lit(0.0), lambda s, x: s + x)
    forward = F.size(F.filter(F.get(sequence, F.lit(1)), lambda d: d > 0)).cast("double")
    return rows.withColumns({"bytes": total(2), "pause": total(0), "forward": forward})


def _sequence_model(spark, sf):
    flows = v.flows(spark, sf, text=False)
    up = F.when(F.col("BYTES") >= F.col("BYTES_REV"), "up").otherwise("down")
    rows = _window_features(flows.withColumn("APP", up), "PPI").select("APP", *_WINDOW_FEATURES)
    # Written without the columns that the tree does not look at, which then are not assembled either.
    rows = write_table(rows, scratch_path(spark, "learn"))
    return models.train(rows, models.decision_tree(min_rows=5, depth=4), features=_WINDOW_FEATURES)


@query("st_late", _windows_sql(f"packets WHERE ts >= TIMESTAMP '{SPLIT}'", v.IDLE_US))
def st_late(spark, sf):
    """Recent packets first, then all older ones: those come too late and are dropped."""
    folder, output, marks = (scratch_path(spark, name) for name in ("arrivals", "stream", "marks"))
    events = v.table(spark, sf, "events")
    recent = F.col("ts") >= F.lit(SPLIT).cast("timestamp_ntz")
    for part in (events.filter(recent), events.filter(~recent)):
        part.write.mode("append").parquet(folder)
        arrivals = v.events_to_packets(st.read_stream(spark, folder, v.LAYOUTS["events"]))
        windows = st.count_windows(
            arrivals, ["flow_key"], unit_us=v.UNIT_US, delay=DELAY, idle_ms=v.IDLE_US // 1000
        )
        result = st.run_once(windows, output=output, marks=marks)
    return _summarized(result)


@query(
    "st_sessions",
    f"""
    , idle_flows AS (SELECT *, sum(CASE WHEN idle_new THEN 1 ELSE 0 END) OVER
                       (PARTITION BY flow_key ORDER BY ts_us, packet_id) AS session FROM opened)
    SELECT flow_key, min(ts_us) AS first_us, max(ts_us) AS last_us,
           count(*) FILTER (WHERE direction = 1) AS PACKETS, count(*) FILTER (WHERE direction = -1) AS PACKETS_REV,
           CAST(coalesce(sum(size) FILTER (WHERE direction = 1), 0) AS BIGINT) AS BYTES,
           CAST(coalesce(sum(size) FILTER (WHERE direction = -1), 0) AS BIGINT) AS BYTES_REV
    FROM idle_flows GROUP BY flow_key, session
    HAVING max(ts_us) + {v.IDLE_US} <= (SELECT max(ts_us) FROM packets) - {DELAY_US}
    """,
)
def st_sessions(spark, sf):
    return st.run_once(st.sessions(_packets(spark, sf), ["flow_key"], "24 hours", DELAY))


@query("st_totals", "SELECT count(*) AS packets, CAST(sum(size) AS BIGINT) AS bytes FROM packets")
def st_totals(spark, sf):
    """Totals of a stream are rewritten after every micro-batch; the last version remains."""
    output = scratch_path(spark, "totals")
    st.run_batches(
        st.packet_totals(_packets(spark, sf)),
        lambda batch, _: batch.write.mode("overwrite").parquet(output),
        mode="complete",
    )
    return spark.read.schema("packets long, bytes long").parquet(output)


@query("st_replay", "SELECT ID, head_id, APP, CAST(unnest(range(2)) AS BIGINT) AS epoch FROM flows WHERE APP IS NOT NULL")
def st_replay(spark, sf):
    """Two epochs of labelled flows in an order of their own each, replayed in some ten micro-batches."""
    flows = v.flows(spark, sf, text=False, stored=True).filter(F.col("APP").isNotNull()).select("ID", "head_id", "APP")
    marks, output = scratch_path(spark, "marks"), scratch_path(spark, "replayed")
    slots = max(1, -(-flows.count() // 5))
    replay = Replay.of(flows, "head_id", slots, epochs=2)
    replay.run(lambda batch, number: batch.write.mode("overwrite").parquet(f"{output}/batch={number}"), marks)
    return spark.read.parquet(output).select("ID", "head_id", "APP", "epoch")


@query("st_score")
def st_score(spark, sf):
    train, valid = learning.features(spark, sf)
    model = models.train(train, models.decision_tree())
    path = scratch_path(spark, "requests")
    valid.drop("is_validation").write.parquet(path)
    stream = st.read_stream(spark, path, valid.drop("is_validation").schema)
    return st.run_once(st.score_stream(model, stream, ["ID"]))


