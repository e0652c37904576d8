"""Table layouts and feature lists."""

from __future__ import annotations

# Names, order and sizes that stored flow files, saved models and
# scoring requests rely on.
LABEL = "APP"
SEQUENCE_LENGTH = 30
HISTOGRAM_SIZE = 8
HISTOGRAM_NAMES = ["PHIST_SRC_SIZES", "PHIST_DST_SIZES", "PHIST_SRC_IPT", "PHIST_DST_IPT"]
# Largest value of bins 0 to 6; everything above falls into bin 7.
HISTOGRAM_UPPER_EDGES = [15, 31, 63, 127, 255, 511, 1024]
BASE_FEATURES = [
    "DURATION",
    "BYTES",
    "BYTES_REV",
    "PACKETS",
    "PACKETS_REV",
    "PPI_LEN",
    "PPI_DURATION",
    "PPI_ROUNDTRIPS",
    "FLOW_ENDREASON_IDLE",
    "FLOW_ENDREASON_ACTIVE",
    "FLOW_ENDREASON_OTHER",
    "DST_ASN",
    "SRC_PORT",
    "DST_PORT",
    "PROTOCOL",
]
DERIVED_FEATURES = [
    "TOTAL_BYTES",
    "TOTAL_PACKETS",
    "BYTES_RATIO",
    "PACKETS_RATIO",
    "BYTES_BALANCE",
    "PACKETS_BALANCE",
    "MEAN_PACKET_SIZE_FWD",
    "MEAN_PACKET_SIZE_REV",
    "BYTES_PER_SECOND",
    "PACKETS_PER_SECOND",
    "PPI_DENSITY",
    "PPI_ROUNDTRIP_RATIO",
    "LOG_TOTAL_BYTES",
    "LOG_TOTAL_PACKETS",
    "START_HOUR",
    "START_MINUTE_OF_DAY",
    "START_DAY_OF_WEEK",
    "IS_WEEKEND",
    "DURATION_FROM_TIMESTAMPS",
    "QUIC_VERSION_CODE",
]
HISTOGRAM_FEATURES = [f"{h}_BIN_{i}" for h in HISTOGRAM_NAMES for i in range(HISTOGRAM_SIZE)]
FEATURE_COLUMNS = BASE_FEATURES + DERIVED_FEATURES + HISTOGRAM_FEATURES

# Columns of the flow export; sequences and histograms are stored as JSON text.
FLOW_SCHEMA = (
    "ID string, SRC_IP string, DST_IP string, DST_ASN int, SRC_PORT int, DST_PORT int, "
    "PROTOCOL int, QUIC_VERSION long, QUIC_SNI string, QUIC_USER_AGENT string, "
    "TIME_FIRST string, TIME_LAST string, DURATION double, BYTES long, BYTES_REV long, "
    "PACKETS long, PACKETS_REV long, PPI string, PPI_LEN int, PPI_DURATION double, "
    "PPI_ROUNDTRIPS int, PHIST_SRC_SIZES string, PHIST_DST_SIZES string, "
    "PHIST_SRC_IPT string, PHIST_DST_IPT string, APP string, CATEGORY string, "
    "FLOW_ENDREASON_IDLE int, FLOW_ENDREASON_ACTIVE int, FLOW_ENDREASON_OTHER int"
)

PACKET_SCHEMA = (
    "packet_id long, ts timestamp, src string, dst string, sport int, dport int, "
    "protocol int, payload binary"
)

TRACE_SCHEMA = (
    "ground_truth string, sequences array<array<double>>, tabular array<double>, version_idx int"
)

MANIFEST_SCHEMA = (
    "split string, num_samples long, seq_len int, tab_dim int, num_classes int, "
    "label_to_index map<string,int>, index_to_label array<string>, version_values array<long>, "
    "class_counts array<long>, "
    "normalization struct<seq_mean:array<double>,seq_std:array<double>,"
    "tab_mean:array<double>,tab_std:array<double>>, "
    "chunks array<struct<file:string,num_samples:long>>, schema_version int"
)

# Raw columns the feature tables are computed from (no address, name or agent text:
# those give the label away).
TABULAR_INPUTS = [
    *BASE_FEATURES, "QUIC_VERSION", "TIME_FIRST", "TIME_LAST", *HISTOGRAM_NAMES
]
SEQUENCE_INPUTS = [
    "DURATION", "BYTES", "BYTES_REV", "PACKETS", "PACKETS_REV", "PPI", "PPI_LEN",
    "PPI_DURATION", "PPI_ROUNDTRIPS", "PROTOCOL", "SRC_PORT", "DST_PORT", "QUIC_VERSION",
    *HISTOGRAM_NAMES,
]
