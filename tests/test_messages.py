"""Envelopes: decoding, dead letters, keys, options."""

import datetime as dt

import pytest

from tidewatch import constants as K
from tidewatch import schemas
from tidewatch.sources import messages

T0 = dt.datetime(2024, 1, 1)
GOOD = (
    '{"sensor_id":"s1","sensor_type":"motion","location":"outdoor","timestamp":"2024-01-02T03:04:05.000678",'
    '"value":1,"unit":"boolean","is_anomaly":false,"source":"sensor_simulator","extra":[1,2]}'
)


@pytest.fixture(scope="module")
def envelope(spark):
    rows = [
        ("k0", GOOD, K.SENSOR_STREAM, 0, 0, T0),
        ("k1", GOOD[:40], K.SENSOR_STREAM, 0, 1, T0),
        ("k2", None, K.SENSOR_STREAM, 0, 2, T0),
        ("k3", '{"sensor_id":"s2","timestamp":"2024-01-02T03:04:05"}', K.SENSOR_STREAM, 1, 3, T0),
        ("k4", GOOD, "unheard-of", 1, 4, T0),
        ("k5", '{"user_id":"u","timestamp":"2024-01-02T03:04:05","topic":"tech","engagement_count":3}',
         K.SOCIAL_STREAM, 0, 0, T0),
        (None, '{"symbol":"AB","price":1.5,"timestamp":"2024-01-02T03:04:05","topic":"not a market field"}', K.MARKET_STREAM, 0, 0, T0),
        ("k7", GOOD, None, 0, 5, T0),
        ("k8", '{"sensor_id":"s3","value":"high"}', K.SENSOR_STREAM, 1, 6, T0),
        ("k9", "[1]x", K.SENSOR_STREAM, 1, 7, T0),
        ("k10", '{"sensor_id":"s4","value":1.5}', K.SENSOR_STREAM, 1, 8, T0),
    ]
    return spark.createDataFrame(rows, schemas.ENVELOPE)


def test_decode_keeps_good_messages(envelope):
    out = {(row["stream"], row["offset"]): row for row in messages.decode(envelope).collect()}
    assert set(out) == {(K.SENSOR_STREAM, 0), (K.SENSOR_STREAM, 3), (K.SOCIAL_STREAM, 0), (K.MARKET_STREAM, 0)}
    row = out[K.SENSOR_STREAM, 0]
    assert (row["value"], row["unit"], row["timestamp"]) == (1.0, "boolean", dt.datetime(2024, 1, 2, 3, 4, 5, 678))
    assert out[K.SENSOR_STREAM, 3]["sensor_id"] == "s2" and out[K.SENSOR_STREAM, 3]["value"] is None
    assert out[K.SOCIAL_STREAM, 0]["topic"] == "tech" and out[K.SOCIAL_STREAM, 0]["ingest_time"] == T0
    assert out[K.MARKET_STREAM, 0]["price"] == 1.5 and out[K.MARKET_STREAM, 0]["topic"] is None


def test_dead_letters_say_why_and_keep_the_text(envelope):
    out = {row["key"]: (row["error"], row["value"]) for row in messages.dead_letters(envelope).collect()}
    assert out == {
        "k1": ("malformed value", GOOD[:40]),
        "k2": ("no value", None),
        "k4": ("unknown stream", GOOD),
        "k7": ("unknown stream", GOOD),
        "k8": ("malformed value", '{"sensor_id":"s3","value":"high"}'),
        "k9": ("malformed value", "[1]x"),
        "k10": ("no time", '{"sensor_id":"s4","value":1.5}'),
    }


def test_each_message_is_parsed_once(envelope):
    plan = messages.decode(envelope)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == len(K.STREAMS)


def test_batch_is_ordered_and_cut_exactly(envelope):
    out = messages.consume_batch(messages.subscribe(envelope, [K.SENSOR_STREAM]), 4).collect()
    assert [(row["partition"], row["offset"]) for row in out] == [(0, 0), (0, 1), (0, 2), (1, 3)]


def keys(spark, values, kind):
    df = spark.createDataFrame([(v,) for v in values], f"k {kind}")
    return [row["key"] for row in messages.encode(df, "s", "k").collect()]


def test_message_keys(spark):
    assert keys(spark, ["a", "", None], "string") == ["a", "", None]
    assert keys(spark, [5, 0, None], "long") == ["5", None, None]
    assert keys(spark, [2.5, 0.0], "double") == ["2.5", None]
    assert keys(spark, [True, False], "boolean") == ["true", None]
    assert keys(spark, [[1, 2], []], "array<int>") == ["[1,2]", None]
    assert keys(spark, [(1,)], "struct<a:int>") == ['{"a":1}']
    df = spark.createDataFrame([(1,)], "a int")
    assert tuple(messages.encode(df, "s").first()) == ("s", None, '{"a":1}')


def test_feed_leaves_out_nulls(spark):
    df = spark.createDataFrame([(1, None, T0)], "a int, b string, t timestamp")
    assert messages.json_feed(df).first()["value"] == '{"a":1,"t":"2024-01-01T00:00:00.000000"}'


def test_kafka_options():
    options = messages.kafka_options("h:1")
    assert options == {
        "kafka.bootstrap.servers": "h:1",
        "subscribe": "sensor-data,social-data,market-data",
        "startingOffsets": "latest",
        "failOnDataLoss": "false",
        "maxOffsetsPerTrigger": "10000",
    }
    options = messages.kafka_options("h:1", starting="earliest", max_offsets=None, pattern=".*-data")
    assert options["subscribePattern"] == ".*-data" and "subscribe" not in options
    assert "maxOffsetsPerTrigger" not in options


def test_kafka_rows(spark):
    row = (bytearray(b"k"), bytearray(b"v"), "t", 1, 2, T0, 0)
    df = spark.createDataFrame(
        [row], "key binary, value binary, topic string, partition int, offset long, timestamp timestamp, timestampType int"
    )
    out = messages.from_kafka_rows(df)
    assert out.schema.names == schemas.ENVELOPE.names and tuple(out.first()) == ("k", "v", "t", 1, 2, T0)
