"""Record shapes. Event time is TIMESTAMP so the same schema serves watermarks."""

from pyspark.sql import types as T

from tidewatch.constants import MARKET_STREAM, SENSOR_STREAM, SOCIAL_STREAM


ENVELOPE = (
    T.StructType()
    .add("key", "string")
    .add("value", "string")
    .add("stream", "string")
    .add("partition", "integer")
    .add("offset", "long")
    .add("ingest_time", "timestamp")
)

SENSOR = (
    T.StructType()
    .add("sensor_id", "string")
    .add("sensor_type", "string")
    .add("location", "string")
    .add("timestamp", "timestamp")
    .add("value", "double")
    .add("unit", "string")
    .add("is_anomaly", "boolean")
    .add("source", "string")
)

SOCIAL = (
    T.StructType()
    .add("user_id", "string")
    .add("timestamp", "timestamp")
    .add("content", "string")
    .add("topic", "string")
    .add("sentiment", "string")
    .add("engagement_count", "long")
    .add("is_anomaly", "boolean")
    .add("source", "string")
)

MARKET = (
    T.StructType()
    .add("symbol", "string")
    .add("company_name", "string")
    .add("sector", "string")
    .add("price", "double")
    .add("price_change", "double")
    .add("price_change_percent", "double")
    .add("volume", "long")
    .add("timestamp", "timestamp")
    .add("is_anomaly", "boolean")
    .add("source", "string")
)

PAYLOADS = {SENSOR_STREAM: SENSOR, SOCIAL_STREAM: SOCIAL, MARKET_STREAM: MARKET}

# Payload columns carried by more than one kind of record.
SHARED = ("timestamp", "is_anomaly", "source")
