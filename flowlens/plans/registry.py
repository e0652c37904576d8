"""Query registry: each query is a Spark function with, where SQL can say it, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowlens.plans import views as v
from flowlens.schema import HISTOGRAM_NAMES, HISTOGRAM_UPPER_EDGES, SEQUENCE_LENGTH
from flowlens.session import tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; `sql` may use the views of `BASE`."""

    def register(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(tune(spark), sf_dir)

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = BASE + sql.strip()
        return function

    return register


def r6(value: Column) -> Column:
    return F.round(value, 6)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.selectExpr(*[f"round(`{c}`, 6) AS `{c}`" if c in columns else f"`{c}`" for c in df.columns])


def _bin(value: str) -> str:
    whens = " ".join(f"WHEN {value} <= {e} THEN {i}" for i, e in enumerate(HISTOGRAM_UPPER_EDGES))
    return f"(CASE {whens} ELSE 7 END)"


def _histograms() -> str:
    members = [
        ("direction = 1", "size"),
        ("direction = -1", "size"),
        ("direction = 1 AND position > 0", "ipt"),
        ("direction = -1 AND position > 0", "ipt"),
    ]
    return ",\n".join(
        f"count(*) FILTER (WHERE {member} AND {_bin(value)} = {i}) AS {name}_BIN_{i}"
        for name, (member, value) in zip(HISTOGRAM_NAMES, members)
        for i in range(8)
    )


_FORWARD = ", ".join(f"'{t}'" for t in v.FORWARD_TYPES)
_ORDER = "PARTITION BY flow_key ORDER BY ts_us, packet_id"

BASE = f"""
WITH raw AS (
  SELECT event_id AS packet_id, user_id AS flow_key, ts, epoch_us(ts) AS ts_us, event_type,
         CASE WHEN event_type IN ({_FORWARD}) THEN 1 ELSE -1 END AS direction,
         CAST(floor(value * 4) AS BIGINT) AS size,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events
),
ends AS (
  SELECT *, CAST(CASE WHEN k % 10 <> 0 THEN k % 4 END AS BIGINT) AS version,
         '10.0.0.' || flow_key AS client, '192.0.2.' || (k % 8) AS server,
         CAST(flow_key + 1024 AS INTEGER) AS client_port,
         CASE WHEN k % 7 = 0 THEN 80 ELSE 443 END AS server_port,
         CASE WHEN k % 13 = 0 THEN 6 ELSE 17 END AS protocol
  FROM raw
),
packets AS (
  SELECT *,
         CASE WHEN direction = 1 THEN client ELSE server END AS src,
         CASE WHEN direction = 1 THEN server ELSE client END AS dst,
         CASE WHEN direction = 1 THEN client_port ELSE server_port END AS sport,
         CASE WHEN direction = 1 THEN server_port ELSE client_port END AS dport
  FROM ends
),
gaps AS (
  SELECT *, lag(ts_us) OVER w AS prev_us, lag(direction) OVER w AS prev_dir, lead(ts_us) OVER w AS next_us
  FROM packets WINDOW w AS ({_ORDER})
),
opened AS (
  SELECT *, prev_us IS NULL OR ts_us - prev_us > {v.IDLE_US} AS idle_new FROM gaps
),
started AS (
  SELECT *, max(CASE WHEN idle_new THEN ts_us END) OVER ({_ORDER}) AS start_us FROM opened
),
cut AS (
  SELECT *, idle_new OR (ts_us - start_us) // {v.ACTIVE_US} <> (prev_us - start_us) // {v.ACTIVE_US} AS new_flow
  FROM started
),
numbered AS (
  SELECT *, CAST(sum(CASE WHEN new_flow THEN 1 ELSE 0 END) OVER ({_ORDER}) AS BIGINT) AS flow_no FROM cut
),
placed AS (
  SELECT *,
         row_number() OVER (PARTITION BY flow_key, flow_no ORDER BY ts_us, packet_id) - 1 AS position,
         CASE WHEN new_flow THEN 0 ELSE (ts_us - prev_us) // {v.UNIT_US} END AS ipt,
         CASE WHEN new_flow OR direction = prev_dir THEN 0 ELSE 1 END AS turn
  FROM numbered
),
ppi AS (SELECT * FROM placed WHERE position < {SEQUENCE_LENGTH}),
grouped AS (
  SELECT flow_key, flow_no, count(*) AS n,
         count(*) FILTER (WHERE direction = 1) AS PACKETS,
         count(*) FILTER (WHERE direction = -1) AS PACKETS_REV,
         CAST(coalesce(sum(size) FILTER (WHERE direction = 1), 0) AS BIGINT) AS BYTES,
         CAST(coalesce(sum(size) FILTER (WHERE direction = -1), 0) AS BIGINT) AS BYTES_REV,
         min(ts_us) AS first_us, max(ts_us) AS last_us, min(ts) AS first_ts,
         max(ts_us) FILTER (WHERE position < {SEQUENCE_LENGTH}) AS ppi_end,
         CAST(sum(turn) FILTER (WHERE position < {SEQUENCE_LENGTH}) AS INTEGER) AS PPI_ROUNDTRIPS,
         arg_min(event_type, position) AS first_type, arg_max(event_type, position) AS y_pred,
         max(version) FILTER (WHERE position = 0) AS QUIC_VERSION,
         arg_min(k, position) AS k, arg_min(packet_id, position) AS head_id,
         (arg_max(size, position) % 97 + 1) / 100.0::DOUBLE AS p_true,
         max(coalesce(next_us, 9e18::BIGINT)) AS next_us,
         {_histograms()}
  FROM placed GROUP BY flow_key, flow_no
),
finished AS (
  SELECT *, (CASE WHEN next_us = 9e18::BIGINT THEN (SELECT max(ts_us) FROM packets) ELSE next_us END) - last_us
            > {v.IDLE_US} AS idle
  FROM grouped
),
flows AS (
  SELECT *, flow_key || '-' || flow_no AS ID,
         CASE WHEN flow_key % 37 <> 0 THEN first_type END AS APP,
         (last_us - first_us) / 1e6::DOUBLE AS DURATION,
         CAST(least(n, {SEQUENCE_LENGTH}) AS INTEGER) AS PPI_LEN,
         (ppi_end - first_us) / 1e6::DOUBLE AS PPI_DURATION,
         CAST(idle AS INTEGER) AS FLOW_ENDREASON_IDLE,
         CAST(NOT idle AND next_us < 9e18::BIGINT AS INTEGER) AS FLOW_ENDREASON_ACTIVE,
         CAST(NOT idle AND next_us = 9e18::BIGINT AS INTEGER) AS FLOW_ENDREASON_OTHER,
         CAST(flow_key % 16 AS INTEGER) AS DST_ASN, CAST(flow_key + 1024 AS INTEGER) AS SRC_PORT,
         443 AS DST_PORT, 17 AS PROTOCOL,
         CASE WHEN k % 3 = 0 THEN 'agent-' || (k % 5) END AS QUIC_USER_AGENT,
         strftime(first_ts, '%Y-%m-%d') AS day
  FROM finished
),
predictions AS (
  SELECT flow_key, flow_no, head_id, first_us, day, APP AS y_true, y_pred, p_true FROM flows WHERE APP IS NOT NULL
),
totals AS (
  SELECT label, CAST(sum(support) AS BIGINT) AS support, CAST(sum(guessed) AS BIGINT) AS guessed,
         CAST(sum(correct) AS BIGINT) AS correct
  FROM (
    SELECT y_true AS label, 1 AS support, 0 AS guessed, CASE WHEN y_true = y_pred THEN 1 ELSE 0 END AS correct
    FROM predictions
    UNION ALL SELECT y_pred, 0, 1, 0 FROM predictions
  ) GROUP BY label
),
report AS (
  SELECT label, CASE WHEN guessed > 0 THEN correct / guessed ELSE 0 END AS precision,
         CASE WHEN support > 0 THEN correct / support ELSE 0 END AS recall,
         CASE WHEN guessed + support > 0 THEN 2 * correct / (guessed + support) ELSE 0 END AS f1,
         support, correct, guessed
  FROM totals
),
services AS (
  SELECT *, APP || '-' || DST_ASN AS SERVICE FROM flows WHERE APP IS NOT NULL
),
days AS (
  SELECT day, row_number() OVER (ORDER BY day) AS nr, count(*) OVER () AS total FROM (SELECT DISTINCT day FROM flows)
),
train AS (SELECT * FROM services WHERE day IN (SELECT day FROM days WHERE nr <= total - greatest(1, floor(total * 0.9)))),
valid AS (SELECT * FROM services WHERE day IN (SELECT day FROM days WHERE nr > total - greatest(1, floor(total * 0.9)))),
slots AS (SELECT *, CAST(unnest(range({SEQUENCE_LENGTH})) AS INTEGER) AS position FROM flows),
padded AS (
  SELECT f.flow_key, f.flow_no, f.position, CAST(coalesce(p.ipt, 0) AS DOUBLE) AS ipt,
         CAST(coalesce(p.direction, 0) AS DOUBLE) AS direction, CAST(coalesce(p.size, 0) AS DOUBLE) AS size,
         f.PPI_LEN, f.APP
  FROM slots f
  LEFT JOIN ppi p ON p.flow_key = f.flow_key AND p.flow_no = f.flow_no AND p.position = f.position
)
"""
