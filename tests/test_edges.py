"""Edge cases on literal rows."""

import json
import math

import pytest
from pyspark.sql import functions as F

from flowlens.functions import histogram as hist, numeric, packet, sequence as seq, times
from flowlens.operators import encode, metrics, packets as pk, scoring, sampling, sequences, stats, tabular
from flowlens.operators.encode import Dictionary
from flowlens.schema import DERIVED_FEATURES, FEATURE_COLUMNS, HISTOGRAM_NAMES


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("x")])
    return row.select(column.alias("r")).first()["r"]


COUNTERS = dict(
    DURATION=1.0, BYTES=0, BYTES_REV=0, PACKETS=0, PACKETS_REV=0, PPI_LEN=0, PPI_DURATION=0.0, PPI_ROUNDTRIPS=0
)


def features(spark, **changes):
    values = {**COUNTERS, **changes}
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return tabular.engineer(row).first().asDict()


def test_feature_lists():
    assert len(FEATURE_COLUMNS) == 67
    assert len(DERIVED_FEATURES) == 20
    assert sequences.TABULAR_WIDTH == 45


def test_zero_counters(spark):
    f = features(spark)
    assert f["MEAN_PACKET_SIZE_FWD"] == 0 and f["MEAN_PACKET_SIZE_REV"] == 0
    assert f["BYTES_BALANCE"] == 0 and f["PACKETS_BALANCE"] == 0
    assert f["BYTES_RATIO"] == 1 and f["PACKETS_RATIO"] == 1


@pytest.mark.parametrize("duration", [0.0, -1.0])
def test_no_duration(spark, duration):
    f = features(spark, DURATION=duration, BYTES=10, PACKETS=2, PPI_LEN=2, PPI_DURATION=duration)
    assert f["BYTES_PER_SECOND"] == 0 and f["PACKETS_PER_SECOND"] == 0 and f["PPI_DENSITY"] == 0


def test_negative_total(spark):
    f = features(spark, BYTES=-5)
    assert f["TOTAL_BYTES"] == -5 and f["LOG_TOTAL_BYTES"] == 0


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2022-11-21T10-20-30.123456", (10, 620, 0, 0)),
        ("2022-11-27T00-00-00", (0, 0, 6, 1)),
        ("2022-11-21 10:20:30", (10, 620, 0, 0)),
        ("x", (-1, -60, -1, 0)),
        (None, (-1, -60, -1, 0)),
    ],
)
def test_times(spark, text, expected):
    f = features(spark, TIME_FIRST=text, TIME_LAST="2022-11-21T10-20-31.123456")
    names = ["START_HOUR", "START_MINUTE_OF_DAY", "START_DAY_OF_WEEK", "IS_WEEKEND"]
    assert tuple(f[n] for n in names) == expected
    if text and text.endswith("123456"):
        assert f["DURATION_FROM_TIMESTAMPS"] == 1.0
    if text in ("x", None):
        assert f["DURATION_FROM_TIMESTAMPS"] == 0.0


@pytest.mark.parametrize(
    "text, expected",
    [
        ("[1,2,3,4,5,6,7,8]", [1, 2, 3, 4, 5, 6, 7, 8]),
        ("[1,2,3,4,5,6,7,8,9]", [1, 2, 3, 4, 5, 6, 7, 8]),
        ("[1,2,3,4,5,6,7]", [0] * 8),
        ("bad", [0] * 8),
        (None, [0] * 8),
    ],
)
def test_histograms(spark, text, expected):
    schema = ", ".join(f"{h} string" for h in HISTOGRAM_NAMES)
    row = spark.createDataFrame([(text,) * 4], schema)
    wide = tabular.expand_histograms(row).first()
    assert [wide[f"{HISTOGRAM_NAMES[2]}_BIN_{i}"] for i in range(8)] == expected
    assert len(wide) == 32


def test_bin_edges(spark):
    rows = spark.createDataFrame([(x,) for x in (0, 15, 16, 1024, 1025)], "x int")
    assert [r[0] for r in rows.select(hist.bin_index("x")).collect()] == [0, 0, 1, 6, 7]


def ppi(n):
    return json.dumps([list(range(n)), [1] * n, [100] * n])


@pytest.mark.parametrize("text, valid", [(ppi(0), 0), (ppi(3), 3), (ppi(31), 30), (None, 0), ("[[", 0)])
def test_sequences(spark, text, valid):
    parsed = spark.createDataFrame([(text,)], "PPI string").select(seq.parse_ppi(F.col("PPI")).alias("p"))
    row = parsed.select(seq.tensor(F.col("p")).alias("t"), seq.valid_length(F.col("p")).alias("n")).first()
    assert row["n"] == valid
    assert [len(c) for c in row["t"]] == [30, 30, 30]
    assert row["t"][1] == [1.0] * valid + [0.0] * (30 - valid)
    assert row["t"][0][:3] == pytest.approx([math.log1p(i) if i < valid else 0.0 for i in range(3)])


def test_direction_changes(spark):
    def flips(*signs):
        return one(spark, seq.direction_changes(F.array(*[F.lit(s) for s in signs])))

    assert flips(1, -1, 1, 1) == 2
    assert flips(1) == 0
    assert one(spark, seq.direction_changes(F.lit(None).cast("array<int>"))) == 0


@pytest.mark.parametrize("text, value", [("abc", 0.0), (None, 0.0), ("NaN", 0.0), (" 4.5 ", 4.5), ("1e3", 1000.0)])
def test_number(spark, text, value):
    assert spark.createDataFrame([(text,)], "x string").select(numeric.number(F.col("x"))).first()[0] == value


def test_header_hints(spark):
    rows = spark.createDataFrame([(b"",), (None,), (b"\xc3\x01",), (b"\x45",), (b"\x01",)], "p binary")
    got = [r[0] for r in rows.select(packet.header_hint(F.col("p"))).collect()]
    assert got == ["empty", "empty", "quic-long", "quic-short", "unknown"]
    assert one(spark, packet.payload_head(F.lit(b"\xab\xcd\x00\x01\x02\x03\x04"))) == "abcd00010203"


def test_dictionary_order_and_lookups(spark):
    rows = spark.createDataFrame([("b",), ("a",), ("C",), ("a",), (None,)], "x string")
    labels = Dictionary.fit(rows, "x")
    assert labels.values() == ["C", "a", "b"]
    other = spark.createDataFrame([("a",), ("new",), (None,)], "x string")
    assert [r[1] for r in labels.encode(other, "x", "i").collect()] == [1]
    assert sorted(r["i"] for r in labels.encode(other, "x", "i", missing=0).collect()) == [0, 0, 1]
    assert [r[0] for r in labels.unseen(other, "x").collect()] == ["new"]
    decoded = labels.decode(spark.createDataFrame([(2,), (9,)], "i int"), "i", "x").collect()
    assert {r["i"]: r["x"] for r in decoded} == {2: "b", 9: None}


def test_large_dictionary(spark):
    rows = spark.range(500).select((F.col("id") * 7 % 501).cast("string").alias("x"))
    small, large = Dictionary.fit(rows, "x"), Dictionary.fit(rows, "x", broadcast_rows=50)
    assert small.small and not large.small
    assert sorted(map(tuple, small.frame.collect())) == sorted(map(tuple, large.frame.collect()))
    assert large.encode(rows, "x", "i").count() == 500


def test_no_overlap_raises(spark):
    left, right = (spark.createDataFrame([(x,)], "x string") for x in "ab")
    with pytest.raises(ValueError):
        encode.overlap(left, right, "x")


def test_class_without_true_rows(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b")], "y_true string, y_pred string")
    report = {r["label"]: r for r in metrics.class_report(rows).collect()}
    assert (report["b"]["precision"], report["b"]["recall"], report["b"]["f1"], report["b"]["support"]) == (0, 0, 0, 0)
    labels = Dictionary.of_values(spark, ["a", "b", "c"])
    every = metrics.macro_f1_all(rows, labels).first()
    assert every["classes"] == 3
    assert every["macro_f1"] == pytest.approx(metrics.macro_f1(rows).first()["macro_f1"] * 2 / 3, abs=1e-6)
    assert [r["label"] for r in metrics.class_accuracy(rows).collect()] == ["a"]


def test_macro_f1_forms_agree_when_all_classes_occur(spark):
    rows = spark.createDataFrame([("a", "a"), ("b", "a"), ("b", "b")], "y_true string, y_pred string")
    every = metrics.macro_f1_all(rows, Dictionary.fit(rows, "y_true")).first()["macro_f1"]
    assert every == pytest.approx(metrics.macro_f1(rows).first()["macro_f1"], abs=1e-6)


def test_request_shapes(spark):
    def grid(channels, length):
        return [[0.0] * length for _ in range(channels)]

    rows = spark.createDataFrame(
        [(1, grid(3, 30)), (2, grid(2, 30)), (3, grid(3, 29)), (4, None)], "id int, sequences array<array<double>>"
    )
    good, bad = scoring.split_requests(rows)
    assert [r["id"] for r in good.collect()] == [1]
    assert sorted(r["id"] for r in bad.collect()) == [2, 3, 4]
    assert {r["label"] for r in bad.collect()} == {"API_ERROR"}


@pytest.mark.parametrize("width, flagged", [(40, True), (45, False), (49, True)])
def test_tabular_width(spark, width, flagged):
    row = spark.createDataFrame([([1.0] * width,)], "tabular array<double>")
    result = scoring.conform_tabular(row, 45).first()
    assert result["conformed"] is flagged
    assert result["tabular"] == [1.0] * min(width, 45) + [0.0] * max(45 - width, 0)


def test_gap_equal_to_timeout_stays_in_the_flow(spark):
    rows = spark.createDataFrame(
        [(1, 1, 0, 1, 5), (2, 1, 1000, -1, 5), (3, 1, 2001, 1, 5)],
        "packet_id long, flow_key int, ts_us long, direction int, size long",
    )
    flows = pk.label_flows(rows, ["flow_key"], idle_us=1000)
    assert [r["flow_no"] for r in flows.orderBy("packet_id").collect()] == [1, 1, 2]
    table = pk.assemble_flows(flows, ["flow_key"], 1000).orderBy("flow_no").collect()
    assert [r["PACKETS"] + r["PACKETS_REV"] for r in table] == [2, 1]
    assert (table[0]["FLOW_ENDREASON_IDLE"], table[1]["FLOW_ENDREASON_OTHER"]) == (1, 1)
    for r in table:
        sizes = sum(r["PHIST_SRC_SIZES"]) + sum(r["PHIST_DST_SIZES"])
        assert sizes == r["PACKETS"] + r["PACKETS_REV"]


def test_active_timeout(spark):
    rows = spark.range(10).select(
        F.col("id").alias("packet_id"), F.lit(1).alias("k"), (F.col("id") * 10).alias("ts_us"),
        F.lit(1).alias("direction"), F.lit(1).alias("size"),
    )
    flows = pk.assemble_flows(pk.label_flows(rows, ["k"], 50, 40, 1), ["k"], 50).orderBy("flow_no").collect()
    assert [r["PACKETS"] for r in flows] == [4, 4, 2]
    assert [r["FLOW_ENDREASON_ACTIVE"] for r in flows] == [1, 1, 0]


def test_time_split(spark):
    rows = spark.createDataFrame([(d,) for d in "abcde"], "day string")
    train, held = sampling.time_split(rows, "day", 0.2)
    assert (train.count(), [r[0] for r in held.collect()]) == (4, ["e"])
    train, held = sampling.time_split(rows, "day", validation_days=["a", "b"])
    assert (train.count(), held.count()) == (3, 2)
    with pytest.raises(ValueError):
        sampling.time_split(rows.filter("day = 'a'"), "day", 0.2)


def test_short_class_raises(spark):
    rows = spark.range(15).select(F.col("id"), F.lit("a").alias("x"))
    assert sampling.pick_traces(rows, "x", ["a"], 10, ["id"]).count() == 10
    with pytest.raises(ValueError):
        sampling.pick_traces(rows, "x", ["a", "b"], 10, ["id"])
    with pytest.raises(ValueError):
        sampling.pick_traces(rows, "x", ["a"], 9, ["id"])


def test_sample_up_to(spark):
    rows = spark.range(10_000)
    assert sampling.sample_up_to(rows, 20_000, "id").count() == 10_000
    assert 1_500 < sampling.sample_up_to(rows, 2_000, "id").count() < 2_500


def test_stats_of_constant_and_empty_features(spark):
    rows = spark.createDataFrame(
        [([[1.0, 0.0], [1.0, 0.0], [5.0, 0.0]], 1, [3.0, 1.0]), ([[0.0] * 2] * 3, 0, [3.0, 2.0])],
        "sequences array<array<double>>, valid_length int, tabular array<double>",
    )
    fitted = stats.Normalization.fit(rows, 2)
    assert fitted.seq_mean == [1.0, 1.0, 5.0]
    assert fitted.seq_std == pytest.approx([1e-3] * 3)
    assert fitted.tab_mean == [3.0, 1.5] and fitted.tab_std == pytest.approx([1e-3, 0.5])
    empty = stats.Normalization.fit(rows.limit(0), 2)
    assert empty.tab_mean == [0.0, 0.0]


def test_tabular_vector_of_a_known_flow(spark):
    """Values worked out by hand: ln(1 + x) of counts, ports scaled by 65535."""
    bins = "[1,0,2,0,0,0,0,4]"
    row = spark.createDataFrame(
        [(2.0, 1000, 3000, 7, 9, 16, 1.5, 4, 17, 13107, 443, bins)],
        "DURATION double, BYTES long, BYTES_REV long, PACKETS long, PACKETS_REV long, PPI_LEN int, "
        "PPI_DURATION double, PPI_ROUNDTRIPS int, PROTOCOL int, SRC_PORT int, DST_PORT int, h string",
    ).withColumns({h: F.col("h") for h in HISTOGRAM_NAMES})
    vector = sequences.parse_text_columns(row).select(sequences.tabular_vector()).first()[0]
    log = math.log1p
    expected = [log(2.0), log(1000), log(3000), log(4000), log(7), log(9), log(16)]
    assert vector[1:7] == pytest.approx(expected[1:])
    assert vector[11:13] == pytest.approx([0.2, 443 / 65535])
    assert vector[13:21] == pytest.approx([log(x) for x in json.loads(bins)])


def test_empty_tables(spark, sf):
    from flowlens.plans import views as v

    flows = v.flows(spark, sf).limit(0)
    assert tabular.feature_table(flows, keep=["ID"]).count() == 0
    assert Dictionary.fit(flows, "APP").values() == []
    assert times.parse_flow_time(F.lit("x")) is not None
    assert metrics.class_report(v.predictions(spark, sf).limit(0)).count() == 0
