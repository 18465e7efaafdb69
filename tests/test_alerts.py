"""Thresholds, cooldown, texts and requests."""

import datetime as dt

import numpy as np
import pytest
import sequential

from tidewatch.operators import alerts
from tidewatch.operators.cooldown import alert_key, cooldown

START = dt.datetime(2024, 1, 1)
MINUTE = dt.timedelta(minutes=1)


def at(spark, per_key):
    rows = []
    for key, times in per_key.items():
        rows += [(key, START + dt.timedelta(microseconds=int(t)), len(rows) + i) for i, t in enumerate(times)]
    return spark.createDataFrame(rows, "key string, ts timestamp, id long").repartition(4)


def sent_ids(df):
    return {row["id"] for row in df.collect()}


def expected(df, gap):
    want, per_key = set(), {}
    for row in df.orderBy("key", "ts", "id").collect():
        per_key.setdefault(row["key"] or "unknown", []).append(row)
    for rows in per_key.values():
        times = [row["ts"] for row in rows]
        want |= {row["id"] for row, go in zip(rows, sequential.cooldown(times, gap)) if go}
    return want


def test_cooldown_boundary(spark):
    """Exactly the cooldown later sends; the gap counts from the last sent one."""
    seconds = [0, 14 * 60 + 59, 15 * 60, 20 * 60, 30 * 60]
    df = at(spark, {"a": [s * 1_000_000 for s in seconds]})
    sent = cooldown(df, "key", ["ts", "id"], 15).orderBy("ts").collect()
    assert [(row["ts"] - START).seconds for row in sent] == [0, 900, 1800]


@pytest.mark.parametrize("chunk", [3, 64])
@pytest.mark.parametrize("seed", range(2))
def test_cooldown_against_the_sequential_rule(spark, seed, chunk):
    random = np.random.default_rng(seed)
    minute = 60_000_000
    data = {
        "dense": np.sort(random.integers(0, 400 * minute, 1500)),
        "sparse": np.sort(random.integers(0, 4000 * minute, 60)),
        "regular": np.arange(0, 300) * 7 * minute,
        "exact": np.arange(0, 60) * 15 * minute,
        "bursts": np.sort(np.concatenate([b * 100 * minute + random.integers(0, minute, 40) for b in range(8)])),
        "ties": np.repeat(np.arange(0, 40) * 5 * minute, 4),
        "before": -np.sort(-random.integers(-900 * minute, 0, 200))[::-1],
        "single": [5],
    }
    df = at(spark, data)
    got = cooldown(df, "key", ["ts", "id"], 15, chunk_rows=chunk)
    assert sent_ids(got) == expected(df, 15 * MINUTE)


def test_cooldown_over_many_arrow_batches(spark):
    """Chunks that cross Arrow batches, on one busy key: a tree of ten levels."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        times = np.sort(np.random.default_rng(1).integers(0, 5_000 * 60_000_000, 4000))
        df = at(spark, {"busy": times, "b": times[:500], "c": times[3000:]})
        assert sent_ids(cooldown(df, "key", ["ts", "id"], 15, 4)) == expected(df, 15 * MINUTE)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_cooldown_zero_sends_all_and_null_keys_share_one(spark):
    df = at(spark, {"a": [0, 1, 2]})
    assert cooldown(df, "key", ["ts", "id"], 0).count() == 3
    rows = [(None, START, 1), (None, START + MINUTE, 2), ("a", START, 3)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, id long")
    assert sent_ids(cooldown(df, "key", ["ts", "id"], 15)) == {1, 3}


def test_alert_key_defaults(spark):
    rows = [("s", "x"), (None, "x"), ("s", None)]
    df = spark.createDataFrame(rows, "source string, id string")
    assert [row[0] for row in df.select(alert_key()).collect()] == ["s:x", "unknown:x", "s:unknown"]


def test_severity_threshold_and_labels(spark):
    df = spark.createDataFrame([(x,) for x in (0.69, 0.7, 0.71, 0.9, 0.91, 1.0, None)], "severity double")
    out = {row["severity"]: row["severity_label"] for row in alerts.candidates(df).collect()}
    assert out == {0.7: "LOW", 0.71: "MEDIUM", 0.9: "MEDIUM", 0.91: "HIGH", 1.0: "HIGH"}


def message(spark, row, schema):
    df = spark.createDataFrame([row], schema)
    return alerts.with_message(df).collect()[0]


def test_sensor_message(spark):
    time = dt.datetime(2024, 1, 2, 3, 4, 5, 600)
    row = message(
        spark,
        ("sensor_simulator", "s-1", "temperature", "outdoor", 41.5, "°C", time, 4.256, 0.95),
        "source string, sensor_id string, sensor_type string, location string, value double, unit string,"
        " timestamp timestamp, anomaly_score double, severity double",
    )
    assert row["alert_text"] == (
        "[HIGH SEVERITY] Sensor Anomaly Detected\nSensor: s-1 (temperature)\nLocation: outdoor\n"
        "Value: 41.5°C\nAnomaly Score: 4.26\nTimestamp: 2024-01-02T03:04:05.000600"
    )
    assert row["subject"] == "Alert: sensor_simulator Anomaly Detected"


def test_message_defaults(spark):
    row = message(
        spark,
        ("market_data_simulator", None, dt.datetime(2024, 1, 2), 0.5),
        "source string, symbol string, timestamp timestamp, severity double",
    )
    assert row["alert_text"] == (
        "[LOW SEVERITY] Market Anomaly Detected\nSymbol: unknown\nPrice: unknown\nPrice Change: unknown\n"
        "Anomaly Score: 0.00\nTimestamp: 2024-01-02T00:00:00"
    )


def test_message_of_unknown_source_holds_the_record(spark):
    row = message(
        spark,
        ("probe", 7, dt.datetime(2024, 1, 2), 0.8),
        "source string, reading int, timestamp timestamp, severity double",
    )
    lines = row["alert_text"].split("\n")
    assert lines[0] == "[MEDIUM SEVERITY] Anomaly Detected" and lines[1] == "Source: probe"
    assert lines[2].startswith('Details: {"source":"probe","reading":7')


def test_requests(spark):
    rows = [
        ("m", "s", "0.8"), (None, "s", "0.8"), ("m", None, "1"), ("m", "s", None), (None, None, None), ("m", "s", "hi"),
    ]
    df = spark.createDataFrame(rows, "message string, source string, severity string")
    out = alerts.check_requests(df, dt.datetime(2024, 1, 1)).collect()
    assert [row["error"] for row in out] == [
        None,
        "Missing required field: message",
        "Missing required field: source",
        "Missing required field: severity",
        "Missing required field: message",
        "Severity is not a number",
    ]
    assert out[0]["manual"] and out[0]["severity"] == 0.8 and out[0]["timestamp"] == dt.datetime(2024, 1, 1)
    assert out[1]["timestamp"] is None and not out[1]["valid"]


def test_payload_defaults(spark):
    df = spark.createDataFrame(
        [(None, None, START, "text")],
        "source string, anomaly_score double, timestamp timestamp, alert_text string",
    )
    row = alerts.payload(df, ["timestamp"]).collect()[0]
    assert row["source"] == "unknown" and row["severity"] == 0.0
    assert '"text":"text"' in row["payload"]


def test_scores_to_alerts(spark):
    values = [float(i % 3) for i in range(60)] + [500.0] + [float(i % 3) for i in range(60)] + [600.0]
    rows = [("sensor_simulator", "s", START + i * MINUTE, i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "source string, sensor_id string, timestamp timestamp, id long, value double")
    out = alerts.score_to_alerts(df, "sensor_id", "value", ["timestamp", "id"]).orderBy("id").collect()
    assert [row["id"] for row in out] == [60, 121]
    assert all(row["severity"] == 1.0 and "Sensor: s" in row["alert_text"] for row in out)


def test_alerts_without_a_time_are_sent_and_hold_up_none(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("a", None, 1), ("a", at, 2), ("a", None, 3), ("a", at + dt.timedelta(minutes=5), 4), ("a", at + dt.timedelta(minutes=15), 5)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, id long")
    out = cooldown(df, "key", ["ts", "id"])
    assert out.columns == df.columns
    assert sorted(row["id"] for row in out.collect()) == [1, 2, 3, 5]


def test_one_key_for_all_and_one_time_for_all(spark):
    minute = 60_000_000
    random = np.random.default_rng(5)
    for times in (np.zeros(900, int), np.arange(900) * 1000, np.sort(random.integers(0, 40 * minute, 900))):
        df = at(spark, {"hot": times})
        for chunk in (7, 100):
            assert sent_ids(cooldown(df, "key", ["ts", "id"], 15, chunk_rows=chunk)) == expected(df, 15 * MINUTE)


def test_a_key_without_times_in_some_chunks(spark):
    rows = [("a", None if i % 3 else START + i * MINUTE, i) for i in range(400)]
    rows += [("b", None, 1000 + i) for i in range(50)] + [("c", START + i * MINUTE, 2000 + i) for i in range(60)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, id long").repartition(4)
    out = sent_ids(cooldown(df, "key", ["ts", "id"], 15, chunk_rows=9))
    untimed = {i for _, ts, i in rows if ts is None}
    assert out == untimed | expected(df.where("ts IS NOT NULL"), 15 * MINUTE)
