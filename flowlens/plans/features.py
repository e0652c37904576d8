"""Queries: scans, packets, flows, tabular and sequence features."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions import histogram as hist, packet, sequence as seq, times
from flowlens.operators import packets as pk, sampling, scoring, sequences, stats, tabular
from flowlens.operators.encode import Dictionary
from flowlens.plans import views as v
from flowlens.plans.registry import query, r6, rounded
from flowlens.schema import (
    FEATURE_COLUMNS,
    HISTOGRAM_FEATURES,
    HISTOGRAM_NAMES,
    SEQUENCE_LENGTH,
)
from flowlens.session import scratch_path

KEY = ["flow_key", "flow_no"]


@query(
    "traffic_by_app",
    """
    SELECT APP, count(*) AS flows, CAST(sum(BYTES + BYTES_REV) AS BIGINT) AS total_bytes,
           round(avg(BYTES + BYTES_REV), 6) AS mean_bytes,
           round(avg((BYTES + 1.0) / (BYTES_REV + 1.0)), 6) AS mean_ratio,
           round(avg(coalesce(BYTES / nullif(PACKETS, 0), 0)), 6) AS mean_packet_fwd,
           round(avg(CASE WHEN DURATION > 0 THEN (BYTES + BYTES_REV) / DURATION ELSE 0 END), 6) AS mean_rate
    FROM flows WHERE APP IS NOT NULL GROUP BY APP ORDER BY flows DESC, APP
    """,
)
def traffic_by_app(spark, sf):
    flows = v.flows(spark, sf, text=False).filter(F.col("APP").isNotNull())
    names = ["TOTAL_BYTES", "BYTES_RATIO", "MEAN_PACKET_SIZE_FWD", "BYTES_PER_SECOND"]
    features = tabular.derived_only(flows, names, keep=["APP"])
    return (
        features.groupBy("APP")
        .agg(
            F.count(F.lit(1)).alias("flows"),
            F.sum("TOTAL_BYTES").cast("long").alias("total_bytes"),
            r6(F.avg("TOTAL_BYTES")).alias("mean_bytes"),
            r6(F.avg("BYTES_RATIO")).alias("mean_ratio"),
            r6(F.avg("MEAN_PACKET_SIZE_FWD")).alias("mean_packet_fwd"),
            r6(F.avg("BYTES_PER_SECOND")).alias("mean_rate"),
        )
        .orderBy(F.col("flows").desc(), "APP")
    )


@query(
    "scan_project",
    "SELECT event_id, user_id, value, event_type FROM events WHERE event_type IS NOT NULL",
)
def scan_project(spark, sf):
    return tabular.with_label(v.table(spark, sf, "events"), ["event_id", "user_id", "value"], "event_type")


@query("drop_null_label", "SELECT ID, APP FROM flows WHERE APP IS NOT NULL")
def drop_null_label(spark, sf):
    return tabular.with_label(v.flows(spark, sf), ["ID"])


@query(
    "default_fill",
    "SELECT ID, BYTES, 0.0::DOUBLE AS PPI_DENSITY, 0.0::DOUBLE AS START_HOUR FROM flows",
)
def default_fill(spark, sf):
    return tabular.default_fill(v.flows(spark, sf).select("ID", "BYTES"), ["BYTES", "PPI_DENSITY", "START_HOUR"])


_TEXT = """CASE WHEN k % 5 = 0 THEN 'abc' WHEN k % 7 = 0 THEN NULL WHEN k % 11 = 0 THEN 'NaN'
           ELSE CAST(k AS VARCHAR) END"""


@query(
    "numeric_coerce",
    f"""
    SELECT packet_id,
           CASE WHEN isnan(coalesce(TRY_CAST(t AS DOUBLE), 0)) THEN 0
                ELSE coalesce(TRY_CAST(t AS DOUBLE), 0) END AS number
    FROM (SELECT packet_id, {_TEXT} AS t FROM packets)
    """,
)
def numeric_coerce(spark, sf):
    k = F.col("k")
    text = F.when(k % 5 == 0, "abc").when(k % 7 == 0, F.lit(None)).when(k % 11 == 0, "NaN").otherwise(k.cast("string"))
    rows = v.packets(spark, sf).select("packet_id", text.alias("number"))
    return tabular.numeric(rows, ["number"])


@query("hist_expand", f"SELECT flow_key, flow_no, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in HISTOGRAM_FEATURES)} FROM flows")
def hist_expand(spark, sf):
    return tabular.expand_histograms(v.flows(spark, sf).select(*KEY, *HISTOGRAM_NAMES))


def _derived(spark, sf, names):
    return rounded(tabular.derived_only(v.flows(spark, sf), names, keep=["ID"]), *names)


_TOTAL = "(BYTES + BYTES_REV)"
_PACKETS = "(PACKETS + PACKETS_REV)"
# SQL of each derived feature, used by several queries.
_FEATURE_SQL = {
    "TOTAL_BYTES": f"CAST({_TOTAL} AS DOUBLE)",
    "TOTAL_PACKETS": f"CAST({_PACKETS} AS DOUBLE)",
    "BYTES_RATIO": "(BYTES + 1.0::DOUBLE) / (BYTES_REV + 1.0::DOUBLE)",
    "PACKETS_RATIO": "(PACKETS + 1.0::DOUBLE) / (PACKETS_REV + 1.0::DOUBLE)",
    "BYTES_BALANCE": f"(BYTES - BYTES_REV) / CASE WHEN {_TOTAL} = 0 THEN 1 ELSE {_TOTAL} END",
    "PACKETS_BALANCE": f"(PACKETS - PACKETS_REV) / CASE WHEN {_PACKETS} = 0 THEN 1 ELSE {_PACKETS} END",
    "MEAN_PACKET_SIZE_FWD": "coalesce(BYTES / nullif(PACKETS, 0), 0)",
    "MEAN_PACKET_SIZE_REV": "coalesce(BYTES_REV / nullif(PACKETS_REV, 0), 0)",
    "BYTES_PER_SECOND": f"CASE WHEN DURATION > 0 THEN {_TOTAL} / DURATION ELSE 0 END",
    "PACKETS_PER_SECOND": f"CASE WHEN DURATION > 0 THEN {_PACKETS} / DURATION ELSE 0 END",
    "PPI_DENSITY": "CASE WHEN PPI_DURATION > 0 THEN PPI_LEN / PPI_DURATION ELSE 0 END",
    "PPI_ROUNDTRIP_RATIO": "CASE WHEN PPI_LEN > 0 THEN PPI_ROUNDTRIPS / PPI_LEN ELSE 0 END",
    "LOG_TOTAL_BYTES": f"ln(1 + {_TOTAL})",
    "LOG_TOTAL_PACKETS": f"ln(1 + {_PACKETS})",
    "START_HOUR": "hour(first_ts)",
    "START_MINUTE_OF_DAY": "hour(first_ts) * 60 + minute(first_ts)",
    "START_DAY_OF_WEEK": "isodow(first_ts) - 1",
    "IS_WEEKEND": "CASE WHEN isodow(first_ts) >= 6 THEN 1 ELSE 0 END",
    "DURATION_FROM_TIMESTAMPS": "DURATION",
}


def _select(names, kind="DOUBLE"):
    return ", ".join(
        f"round(CAST({_FEATURE_SQL[n]} AS DOUBLE), 6) AS {n}" if kind == "DOUBLE" else f"CAST({_FEATURE_SQL[n]} AS {kind}) AS {n}"
        for n in names
    )


@query("feat_totals", f"SELECT ID, {_select(['TOTAL_BYTES', 'TOTAL_PACKETS'])} FROM flows")
def feat_totals(spark, sf):
    return _derived(spark, sf, ["TOTAL_BYTES", "TOTAL_PACKETS"])


_RATIOS = ["BYTES_RATIO", "PACKETS_RATIO", "BYTES_BALANCE", "PACKETS_BALANCE"]


@query("feat_ratios", f"SELECT ID, {_select(_RATIOS)} FROM flows")
def feat_ratios(spark, sf):
    return _derived(spark, sf, _RATIOS)


_RATES = ["MEAN_PACKET_SIZE_FWD", "MEAN_PACKET_SIZE_REV", "BYTES_PER_SECOND", "PACKETS_PER_SECOND"]


@query("feat_rates", f"SELECT ID, {_select(_RATES)} FROM flows")
def feat_rates(spark, sf):
    return _derived(spark, sf, _RATES)


@query("feat_ppi", f"SELECT ID, {_select(['PPI_DENSITY', 'PPI_ROUNDTRIP_RATIO'])} FROM flows")
def feat_ppi(spark, sf):
    return _derived(spark, sf, ["PPI_DENSITY", "PPI_ROUNDTRIP_RATIO"])


@query("feat_logs", f"SELECT ID, {_select(['LOG_TOTAL_BYTES', 'LOG_TOTAL_PACKETS'])} FROM flows")
def feat_logs(spark, sf):
    return _derived(spark, sf, ["LOG_TOTAL_BYTES", "LOG_TOTAL_PACKETS"])


_TIMES = ["START_HOUR", "START_MINUTE_OF_DAY", "START_DAY_OF_WEEK", "IS_WEEKEND"]


@query(
    "feat_time",
    f"SELECT ID, {_select(_TIMES, 'INTEGER')}, {_select(['DURATION_FROM_TIMESTAMPS'])} FROM flows",
)
def feat_time(spark, sf):
    flows = v.flows(spark, sf)
    start, end = times.parse_flow_time(F.col("TIME_FIRST")), times.parse_flow_time(F.col("TIME_LAST"))
    parsed = flows.select("ID", start.alias("start"), end.alias("end"))
    columns = tabular.time_features(F.col("start"), F.col("end"))
    result = parsed.select("ID", *[c.alias(n) for n, c in columns.items()])
    return rounded(result, "DURATION_FROM_TIMESTAMPS")


_VERSION_CODE = """
    (SELECT value, row_number() OVER (ORDER BY value) AS idx
     FROM (SELECT DISTINCT QUIC_VERSION AS value FROM flows WHERE QUIC_VERSION IS NOT NULL))
"""


@query(
    "version_code",
    f"""
    SELECT ID, QUIC_VERSION, CAST(coalesce(idx, 0) AS INTEGER) AS QUIC_VERSION_CODE
    FROM flows LEFT JOIN {_VERSION_CODE} d ON QUIC_VERSION = value
    """,
)
def version_code(spark, sf):
    flows = v.flows(spark, sf, stored=True).select("ID", "QUIC_VERSION")
    return _versions(flows).encode(flows, "QUIC_VERSION", "QUIC_VERSION_CODE", missing=0)


def _versions(flows) -> Dictionary:
    return Dictionary.fit(flows, "QUIC_VERSION", first=1)


_PLAIN = [c for c in FEATURE_COLUMNS if c not in _FEATURE_SQL and c != "QUIC_VERSION_CODE"]


@query(
    "features_tabular",
    f"""
    SELECT ID, APP, {', '.join(f'round(CAST({c} AS DOUBLE), 6) AS {c}' for c in _PLAIN)},
           {_select(_FEATURE_SQL)}, CAST(coalesce(idx, 0) AS DOUBLE) AS QUIC_VERSION_CODE
    FROM flows LEFT JOIN {_VERSION_CODE} d ON QUIC_VERSION = value WHERE APP IS NOT NULL
    """,
)
def features_tabular(spark, sf):
    flows = v.flows(spark, sf, stored=True)
    table = tabular.feature_table(flows.filter(F.col("APP").isNotNull()), _versions(flows), keep=["ID", "APP"])
    return rounded(table, *[c for c in FEATURE_COLUMNS if c not in HISTOGRAM_FEATURES])


@query(
    "hash_code",
    """
    , versions AS (SELECT coalesce(CAST(QUIC_VERSION AS VARCHAR), 'UNKNOWN') AS version, count(*) AS flows FROM flows GROUP BY ALL)
    SELECT flows, true AS repeatable, (SELECT count(DISTINCT version) FROM versions) AS codes FROM versions
    """,
)
def hash_code(spark, sf):
    """Rows per code: codes that collide would join two versions' rows and lower the number of codes.

    A code is repeatable if the version's text, read back, has it, too.
    """
    version = F.col("QUIC_VERSION")
    again = tabular.version_hash(F.coalesce(version.cast("string"), F.lit("UNKNOWN")))
    rows = v.flows(spark, sf).select(tabular.version_hash(version).alias("code"), again.alias("again"))
    per_code = rows.groupBy("code").agg(
        F.count(F.lit(1)).alias("flows"), F.bool_and(F.col("code") == F.col("again")).alias("repeatable")
    )
    codes = per_code.agg(F.count(F.lit(1)).alias("codes"))
    return per_code.drop("code").join(F.broadcast(codes))


# Packets ---------------------------------------------------------------------------


@query(
    "packet_filter",
    "SELECT packet_id, src, dst, sport, dport FROM packets WHERE protocol = 17 AND 443 IN (sport, dport)",
)
def packet_filter(spark, sf):
    return pk.quic_packets(v.packets(spark, sf)).select("packet_id", "src", "dst", "sport", "dport")


@query(
    "header_hint",
    """
    SELECT packet_id,
           CASE WHEN k % 10 = 9 THEN 'empty' WHEN (k * 2) & 128 <> 0 THEN 'quic-long'
                WHEN (k * 2) & 64 <> 0 THEN 'quic-short' ELSE 'unknown' END AS hint,
           CASE WHEN k % 10 = 9 THEN '' ELSE lower(lpad(hex(k * 2), 2, '0')) END AS head
    FROM packets
    """,
)
def header_hint(spark, sf):
    payload = F.col("payload")
    return v.packets(spark, sf).select(
        "packet_id", packet.header_hint(payload).alias("hint"), packet.payload_head(payload).alias("head")
    )


@query(
    "canonical_key",
    """
    SELECT CASE WHEN fwd THEN src ELSE dst END AS src, CASE WHEN fwd THEN sport ELSE dport END AS sport,
           CASE WHEN fwd THEN dst ELSE src END AS dst, CASE WHEN fwd THEN dport ELSE sport END AS dport,
           count(*) AS packets
    FROM (SELECT *, (src, sport, dst, dport) <= (dst, dport, src, sport) AS fwd FROM packets) GROUP BY ALL
    """,
)
def canonical_key(spark, sf):
    key = packet.canonical_key(F.col("src"), F.col("sport"), F.col("dst"), F.col("dport"))
    keyed = v.packets(spark, sf).select(key.alias("key")).select("key.*")
    return keyed.groupBy("src", "sport", "dst", "dport").agg(F.count(F.lit(1)).alias("packets"))


_LOCAL = [f"192.0.2.{i}" for i in (0, 2, 5)]


@query(
    "packet_direction",
    f"SELECT packet_id, CASE WHEN src IN ({', '.join(map(repr, _LOCAL))}) THEN 1 ELSE -1 END AS sign FROM packets",
)
def packet_direction(spark, sf):
    return v.packets(spark, sf).select("packet_id", packet.direction(F.col("src"), _LOCAL).alias("sign"))


@query(
    "ipt_lag",
    f"SELECT packet_id, flow_key, greatest(coalesce(ts_us - prev_us, 0), 0) // {v.UNIT_US} AS ipt FROM gaps",
)
def ipt_lag(spark, sf):
    return pk.packet_gaps(v.packets(spark, sf), ["flow_key"], v.UNIT_US).select("packet_id", "flow_key", "ipt")


_COUNTERS = ["PACKETS", "PACKETS_REV", "BYTES", "BYTES_REV", "first_us", "last_us"]
_REASONS = [f"FLOW_ENDREASON_{r}" for r in ("IDLE", "ACTIVE", "OTHER")]


@query(
    "flow_sessions",
    f"SELECT flow_key, flow_no, {', '.join(_COUNTERS + _REASONS)}, PPI_LEN, PPI_ROUNDTRIPS, APP, QUIC_VERSION FROM flows",
)
def flow_sessions(spark, sf):
    return v.flows(spark, sf, text=False).select(
        *KEY, *_COUNTERS, *_REASONS, "PPI_LEN", "PPI_ROUNDTRIPS", "APP", "QUIC_VERSION"
    )


_WINDOWS = f"""
    runs AS (SELECT *, row_number() OVER ({{order}}) - 1 AS nth FROM gaps),
    windows AS (
      SELECT *, nth // {SEQUENCE_LENGTH} AS window_no, CAST(nth % {SEQUENCE_LENGTH} AS INTEGER) AS position,
             count(*) OVER (PARTITION BY flow_key, nth // {SEQUENCE_LENGTH}) AS held,
             CASE WHEN nth % {SEQUENCE_LENGTH} = 0 THEN 0 ELSE (ts_us - prev_us) // {v.UNIT_US} END AS gap
      FROM runs)
    SELECT flow_key, window_no, position, CAST(gap AS DOUBLE) AS ipt, CAST(direction AS DOUBLE) AS direction,
           CAST(size AS DOUBLE) AS size
    FROM windows WHERE held = {SEQUENCE_LENGTH}
""".format(order="PARTITION BY flow_key ORDER BY ts_us, packet_id")


@query("count_window", "," + _WINDOWS)
def count_window(spark, sf):
    windows = pk.count_windows(v.packets(spark, sf), ["flow_key"], SEQUENCE_LENGTH, v.UNIT_US)
    return pk.sequence_rows(windows, ["flow_key", "window_no"], "sequence")


# A third of the flow keys folded into one: far more rows than a task should sort.
_FOLDED = "CASE WHEN flow_key % 3 = 0 THEN 0 ELSE flow_key END"
_SKEWED = f"""
    , folded AS (SELECT * EXCLUDE (flow_key), {_FOLDED} AS flow_key FROM packets),
    skewed AS (SELECT *, lag(ts_us) OVER (PARTITION BY flow_key ORDER BY ts_us, packet_id) AS prev_us FROM folded)
"""
SKEW_TASKS = 20


def _skewed(spark, sf):
    """Packets with one hot key, and the rows a task may hold so that the key has to be split."""
    packets = v.packets(spark, sf)
    key = F.when(F.col("flow_key") % 3 == 0, F.lit(0)).otherwise(F.col("flow_key"))
    rows = v.table(spark, sf, "events").count()
    return packets.withColumn("flow_key", key.cast("long")), max(1, rows // SKEW_TASKS)


@query(
    "skewed_gaps",
    _SKEWED
    + f"SELECT packet_id, flow_key, greatest(coalesce(ts_us - prev_us, 0), 0) // {v.UNIT_US} AS ipt FROM skewed",
)
def skewed_gaps(spark, sf):
    packets, rows = _skewed(spark, sf)
    return pk.packet_gaps(packets, ["flow_key"], v.UNIT_US, rows).select("packet_id", "flow_key", "ipt")


@query(
    "skewed_flows",
    _SKEWED
    + f"""
    , s1 AS (SELECT *, prev_us IS NULL OR ts_us - prev_us > {v.IDLE_US} AS idle_new FROM skewed),
    s2 AS (SELECT *, max(CASE WHEN idle_new THEN ts_us END) OVER (PARTITION BY flow_key ORDER BY ts_us, packet_id) AS start_us FROM s1),
    s3 AS (
      SELECT *, idle_new OR (ts_us - start_us) // {v.ACTIVE_US} <> (prev_us - start_us) // {v.ACTIVE_US} AS new_flow FROM s2
    ),
    s4 AS (
      SELECT packet_id, flow_key, ts_us,
             CAST(sum(CASE WHEN new_flow THEN 1 ELSE 0 END) OVER (PARTITION BY flow_key ORDER BY ts_us, packet_id) AS BIGINT) AS flow_no
      FROM s3
    )
    SELECT packet_id, flow_key, flow_no,
           row_number() OVER (PARTITION BY flow_key, flow_no ORDER BY ts_us, packet_id) - 1 AS position
    FROM s4
    """,
)
def skewed_flows(spark, sf):
    packets, rows = _skewed(spark, sf)
    labelled = pk.label_flows(packets, ["flow_key"], v.IDLE_US, v.ACTIVE_US, v.UNIT_US, rows)
    return labelled.select("packet_id", "flow_key", "flow_no", "position")


@query("skewed_windows", _SKEWED + "," + _WINDOWS.replace("FROM gaps", "FROM skewed"))
def skewed_windows(spark, sf):
    packets, rows = _skewed(spark, sf)
    windows = pk.count_windows(packets, ["flow_key"], SEQUENCE_LENGTH, v.UNIT_US, rows)
    return pk.sequence_rows(windows, ["flow_key", "window_no"], "sequence")


@query(
    "flow_sequence",
    """
    SELECT flow_key, flow_no, CAST(position AS INTEGER) AS position, CAST(ipt AS DOUBLE) AS ipt,
           CAST(direction AS DOUBLE) AS direction, CAST(size AS DOUBLE) AS size
    FROM ppi
    """,
)
def flow_sequence(spark, sf):
    return pk.sequence_rows(pk.first_packets(v.labelled(spark, sf), ["flow_key"]), KEY, "sequence")


_STATS = ", ".join(
    f"""CAST(sum({x}) AS BIGINT) AS {x}_total, round(avg({x}), 6) AS {x}_mean,
        round(quantile_cont({x}, 0.5), 6) AS {x}_median, round(stddev_samp({x}), 6) AS {x}_std,
        min({x}) AS {x}_min, max({x}) AS {x}_max"""
    for x in ("size", "ipt")
)


@query(
    "packet_stats",
    f"""
    SELECT flow_key, flow_no, count(*) AS packets, count(*) FILTER (WHERE direction = 1) AS packets_fwd,
           count(*) FILTER (WHERE direction = -1) AS packets_rev, {_STATS}
    FROM placed GROUP BY flow_key, flow_no
    """,
)
def packet_stats(spark, sf):
    result = pk.packet_stats(v.labelled(spark, sf), KEY)
    return rounded(result, *[f"{x}_{m}" for x in ("size", "ipt") for m in ("mean", "median", "std")])


@query(
    "order_volumes",
    """
    SELECT l_orderkey AS flow_key, count(*) AS packets,
           count(*) FILTER (WHERE l_returnflag = 'N') AS packets_fwd,
           count(*) FILTER (WHERE l_returnflag <> 'N') AS packets_rev,
           CAST(sum(l_quantity) AS BIGINT) AS size_total, round(avg(l_quantity), 6) AS size_mean,
           round(quantile_cont(l_quantity, 0.5), 6) AS size_median, round(stddev_samp(l_quantity), 6) AS size_std,
           CAST(min(l_quantity) AS BIGINT) AS size_min, CAST(max(l_quantity) AS BIGINT) AS size_max
    FROM lineitem GROUP BY l_orderkey
    """,
)
def order_volumes(spark, sf):
    rows = v.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("flow_key"),
        F.when(F.col("l_returnflag") == "N", 1).otherwise(-1).alias("direction"),
        F.col("l_quantity").cast("long").alias("size"),
    )
    return rounded(pk.packet_stats(rows, ["flow_key"], ["size"]), "size_mean", "size_median", "size_std")


@query(
    "flow_histograms",
    f"SELECT flow_key, flow_no, {', '.join(HISTOGRAM_FEATURES)} FROM flows",
)
def flow_histograms(spark, sf):
    counts = pk.flow_histograms(v.labelled(spark, sf), ["flow_key"])
    return counts.selectExpr(*KEY, *[f"get({h}, {i}) AS {h}_BIN_{i}" for h in HISTOGRAM_NAMES for i in range(8)])


@query(
    "hist_bins",
    """
    SELECT CASE WHEN size < 16 THEN 0 WHEN size < 32 THEN 1 WHEN size < 64 THEN 2 WHEN size < 128 THEN 3
                WHEN size < 256 THEN 4 WHEN size < 512 THEN 5 WHEN size <= 1024 THEN 6 ELSE 7 END AS bin,
           count(*) AS packets
    FROM packets GROUP BY bin
    """,
)
def hist_bins(spark, sf):
    return pk.bin_counts(v.packets(spark, sf), "size")


@query("last_n", "SELECT packet_id, ts_us, size FROM packets ORDER BY ts_us DESC, packet_id DESC LIMIT 20")
def last_n(spark, sf):
    return pk.last_packets(v.packets(spark, sf), 20).select("packet_id", "ts_us", "size")


# Sequences -------------------------------------------------------------------------


@query(
    "ppi_parse",
    """
    SELECT flow_key, flow_no, CAST(position AS INTEGER) AS position, CAST(ipt AS DOUBLE) AS ipt,
           CAST(direction AS DOUBLE) AS direction, CAST(size AS DOUBLE) AS size
    FROM ppi
    """,
)
def ppi_parse(spark, sf):
    parsed = sequences.parse_text_columns(v.flows(spark, sf).select(*KEY, "PPI"))
    return pk.sequence_rows(parsed, KEY, "PPI")


@query("seq_pad", "SELECT flow_key, flow_no, position, size FROM padded")
def seq_pad(spark, sf):
    parsed = v.flows(spark, sf).select(*KEY, seq.parse_ppi(F.col("PPI")).alias("ppi"))
    return parsed.select(*KEY, F.posexplode(seq.pad(seq.channel(F.col("ppi"), 2))).alias("position", "size"))


@query("seq_log_ipt", "SELECT flow_key, flow_no, CAST(position AS INTEGER) AS position, round(ln(1 + ipt), 6) AS log_ipt FROM ppi")
def seq_log_ipt(spark, sf):
    parsed = v.flows(spark, sf).select(*KEY, seq.parse_ppi(F.col("PPI")).alias("ppi"))
    logs = seq.log_times(seq.channel(F.col("ppi"), 0))
    return rounded(parsed.select(*KEY, F.posexplode(logs).alias("position", "log_ipt")), "log_ipt")


@query(
    "seq_tensor",
    """
    SELECT flow_key, flow_no, PPI_LEN AS valid_length, position, round(ln(1 + ipt), 6) AS ipt, direction, size
    FROM padded
    """,
)
def seq_tensor(spark, sf):
    parsed = v.flows(spark, sf).select(*KEY, seq.parse_ppi(F.col("PPI")).alias("ppi"))
    tensors = parsed.select(
        *KEY, seq.valid_length(F.col("ppi")).alias("valid_length"), seq.tensor(F.col("ppi")).alias("tensor")
    )
    return rounded(pk.sequence_rows(tensors, [*KEY, "valid_length"], "tensor"), "ipt")


@query(
    "hist_log",
    f"SELECT flow_key, flow_no, {', '.join(f'round(ln(1 + {c}), 6) AS {c}' for c in HISTOGRAM_FEATURES)} FROM flows",
)
def hist_log(spark, sf):
    parsed = sequences.parse_text_columns(v.flows(spark, sf).select(*KEY, *HISTOGRAM_NAMES))
    logs = parsed.withColumns({h: hist.log_bins(F.col(h)) for h in HISTOGRAM_NAMES})
    return logs.selectExpr(
        *KEY, *[f"round(get({h}, {i}), 6) AS {h}_BIN_{i}" for h in HISTOGRAM_NAMES for i in range(8)]
    )


SEQ_VALUES_SQL = [
    "DURATION",
    *[f"ln(1 + {e})" for u in ("BYTES", "PACKETS") for e in (u, f"{u}_REV", f"{u} + {u}_REV")],
    f"PPI_LEN / {SEQUENCE_LENGTH}.0::DOUBLE",
    "PPI_DURATION",
    "CAST(PPI_ROUNDTRIPS AS DOUBLE)",
    "CAST(PROTOCOL AS DOUBLE)",
    "SRC_PORT / 65535.0::DOUBLE",
    "DST_PORT / 65535.0::DOUBLE",
    *[f"ln(1 + {c})" for c in HISTOGRAM_FEATURES],
]


@query(
    "features_seq_tabular",
    f"SELECT ID, {', '.join(f'round({x}, 6) AS t{i}' for i, x in enumerate(SEQ_VALUES_SQL))} FROM flows",
)
def features_seq_tabular(spark, sf):
    parsed = sequences.parse_text_columns(v.flows(spark, sf))
    vectors = parsed.select("ID", sequences.tabular_vector().alias("tabular"))
    return vectors.selectExpr(
        "ID", *[f"round(get(tabular, {i}), 6) AS t{i}" for i in range(sequences.TABULAR_WIDTH)]
    )


@query(
    "ppi_derived",
    """
    SELECT flow_key, flow_no, CAST(count(*) AS INTEGER) AS length, round(sum(ipt) / 1000.0::DOUBLE, 6) AS duration,
           CAST(sum(turn) AS INTEGER) AS roundtrips
    FROM ppi GROUP BY flow_key, flow_no
    """,
)
def ppi_derived(spark, sf):
    parsed = v.flows(spark, sf).select(*KEY, seq.parse_ppi(F.col("PPI")).alias("ppi"))
    ppi = F.col("ppi")
    return parsed.select(
        *KEY,
        seq.ppi_length(ppi).alias("length"),
        r6(seq.ppi_duration(ppi)).alias("duration"),
        seq.direction_changes(seq.channel(ppi, 1)).alias("roundtrips"),
    )


@query(
    "vec_conform",
    """
    SELECT ID, flow_key % 10 <> 5 AS conformed, CAST(45 AS INTEGER) AS width,
           CAST(least(40 + flow_key % 10, 45) * (least(40 + flow_key % 10, 45) + 1) / 2 AS DOUBLE) AS total
    FROM flows
    """,
)
def vec_conform(spark, sf):
    # Vectors 1, 2, 3, ... of 40 to 49 values.
    length = (F.col("flow_key") % 10 + 40).cast("int")
    ramp = F.transform(F.sequence(F.lit(1), length), lambda x: x.cast("double"))
    vectors = v.flows(spark, sf).select("ID", ramp.alias("tabular"))
    conformed = scoring.conform_tabular(vectors, sequences.TABULAR_WIDTH)
    total = F.aggregate("tabular", F.lit(0.0), lambda s, x: s + x)
    return conformed.select("ID", "conformed", F.size("tabular").alias("width"), total.alias("total"))


def _samples(spark, sf, keep=("ID",)):
    flows = v.flows(spark, sf, stored=True)
    labels = Dictionary.fit(flows, "APP")
    return sequences.samples(flows, labels, _versions(flows), keep=keep)


@query(
    "sequence_only",
    """
    SELECT ID, 0.0::DOUBLE AS tabular_total, CAST(0 AS INTEGER) AS version_idx,
           CAST(sum(size) AS DOUBLE) AS size_total
    FROM (SELECT * FROM flows WHERE APP IS NOT NULL) f JOIN ppi p USING (flow_key, flow_no) GROUP BY ID
    """,
)
def sequence_only(spark, sf):
    blank = sequences.sequence_only(_samples(spark, sf))

    def total(values):
        return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)

    return blank.select(
        "ID",
        total(F.col("tabular")).alias("tabular_total"),
        "version_idx",
        total(F.get("sequences", F.lit(2))).alias("size_total"),
    )


@query(
    "validate_shape",
    """
    SELECT ID, flow_key % 11 <> 0 AND flow_key % 13 <> 0 AS valid,
           CASE WHEN flow_key % 11 <> 0 AND flow_key % 13 <> 0 THEN NULL ELSE 'API_ERROR' END AS label
    FROM flows WHERE APP IS NOT NULL
    """,
)
def validate_shape(spark, sf):
    user = F.col("flow_key")
    damaged = (
        F.when(user % 11 == 0, F.slice("sequences", 1, 2))
        .when(user % 13 == 0, F.transform("sequences", lambda c: F.slice(c, 1, 29)))
        .otherwise(F.col("sequences"))
    )
    requests = _samples(spark, sf, keep=("ID", "flow_key")).withColumn("sequences", damaged)
    good, bad = scoring.split_requests(requests)
    return good.select("ID", F.lit(True).alias("valid"), F.lit(None).cast("string").alias("label")).unionByName(
        bad.select("ID", F.lit(False).alias("valid"), "label")
    )


def _moment_sql(source: str, terms: list[str], where: str = "true") -> str:
    parts = [
        f"""SELECT CAST({i} AS INTEGER) AS position, round(avg({x}), 6) AS mean,
            round(sqrt(greatest(avg(({x}) * ({x})) - avg({x}) * avg({x}), 1e-6)), 6) AS std FROM {source} WHERE {where}"""
        for i, x in enumerate(terms)
    ]
    return " UNION ALL ".join(parts)


_SEQ_TERMS = ["ln(1 + ipt)", "CAST(direction AS DOUBLE)", "CAST(size AS DOUBLE)"]


@query(
    "seq_norm_stats",
    ", real AS (SELECT p.* FROM ppi p JOIN flows f USING (flow_key, flow_no) WHERE f.APP IS NOT NULL) "
    + _moment_sql("real", _SEQ_TERMS),
)
def seq_norm_stats(spark, sf):
    return rounded(stats.sequence_stats(_samples(spark, sf)), "mean", "std")


@query("tab_norm_stats", _moment_sql("flows", SEQ_VALUES_SQL, "APP IS NOT NULL"))
def tab_norm_stats(spark, sf):
    return rounded(stats.tabular_stats(_samples(spark, sf), sequences.TABULAR_WIDTH), "mean", "std")


@query("stats_merge", _moment_sql("flows", SEQ_VALUES_SQL, "APP IS NOT NULL"))
def stats_merge(spark, sf):
    """The same statistics from sums per day: the second half of the days is merged into the stored first half."""
    samples = _samples(spark, sf, keep=("ID", "day"))
    held = stats.FileStatistics(spark, scratch_path(spark, "sums"), sequences.TABULAR_WIDTH)
    late = F.dayofmonth("day") > 15
    held.add(samples.filter(~late), "day")
    held.add(samples.filter(late), "day")
    return rounded(held.moments().filter("part = 't'").drop("part"), "mean", "std")


@query(
    "zscore",
    ", logs AS (SELECT flow_key, flow_no, APP, PPI_LEN, position, ln(1 + ipt) AS ipt, direction, size FROM padded "
    "WHERE APP IS NOT NULL), real AS (SELECT * FROM logs WHERE position < PPI_LEN), m AS (SELECT "
    + ", ".join(
        f"avg({x}) AS m_{x}, sqrt(greatest(avg({x} * {x}) - avg({x}) * avg({x}), 1e-6)) AS s_{x}"
        for x in ("ipt", "direction", "size")
    )
    + " FROM real) SELECT flow_key, flow_no, position, "
    + ", ".join(f"round(({x} - m_{x}) / s_{x}, 5) AS {x}" for x in ("ipt", "direction", "size"))
    + " FROM logs CROSS JOIN m",
)
def zscore(spark, sf):
    samples = _samples(spark, sf, keep=KEY)
    scaled = stats.Normalization.fit(samples, sequences.TABULAR_WIDTH).apply(samples)
    rows = pk.sequence_rows(scaled, KEY, "sequences")
    return rows.withColumns({c: F.round(c, 5) for c in ("ipt", "direction", "size")})


@query(
    "zscore_tab",
    ", vals AS (SELECT ID, APP, "
    + ", ".join(f"{x} AS t{i}" for i, x in enumerate(SEQ_VALUES_SQL))
    + " FROM flows WHERE APP IS NOT NULL), m AS (SELECT "
    + ", ".join(
        f"avg(t{i}) AS m{i}, sqrt(greatest(avg(t{i} * t{i}) - avg(t{i}) * avg(t{i}), 1e-6)) AS s{i}"
        for i in range(len(SEQ_VALUES_SQL))
    )
    + " FROM vals) SELECT ID, "
    + ", ".join(f"round((t{i} - m{i}) / s{i}, 5) AS z{i}" for i in range(len(SEQ_VALUES_SQL)))
    + " FROM vals CROSS JOIN m",
)
def zscore_tab(spark, sf):
    samples = _samples(spark, sf)
    scaled = stats.Normalization.fit(samples, sequences.TABULAR_WIDTH).apply(samples)
    return scaled.select(
        "ID", *[F.round(F.get("tabular", F.lit(i)), 5).alias(f"z{i}") for i in range(sequences.TABULAR_WIDTH)]
    )


@query(
    "path_to_day",
    """
    SELECT 'W-' || day || '/D_Day/flows-' || replace(day, '-', '') || '.csv.gz' AS path,
           'flows-' || replace(day, '-', '') || '.parquet' AS parquet, day, count(*) AS flows
    FROM flows GROUP BY ALL
    """,
)
def path_to_day(spark, sf):
    day = F.date_format("day", "yyyyMMdd")
    path = F.concat(F.lit("W-"), F.col("day").cast("string"), F.lit("/D_Day/flows-"), day, F.lit(".csv.gz"))
    paths = v.flows(spark, sf).select(path.alias("path"))
    return (
        paths.withColumns(
            {
                "parquet": times.parquet_name(F.col("path")),
                "day": times.day_from_path(F.col("path")).cast("string"),
            }
        )
        .groupBy("path", "parquet", "day")
        .agg(F.count(F.lit(1)).alias("flows"))
    )


@query(
    "per_class_topn",
    """
    SELECT APP, ID, CAST(rank AS INTEGER) AS rank FROM (
      SELECT APP, ID, row_number() OVER (PARTITION BY APP ORDER BY first_us, head_id) AS rank
      FROM flows WHERE APP IN ('view', 'click', 'error')) WHERE rank <= 10
    """,
)
def per_class_topn(spark, sf):
    flows = v.flows(spark, sf, text=False, stored=True).select("APP", "ID", "first_us", "head_id")
    picked = sampling.pick_traces(flows, "APP", ["view", "click", "error"], 10, ["first_us", "head_id"])
    return picked.select("APP", "ID", "rank")


