"""Message envelopes: Kafka and file readers, decoding, encoding."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch import constants as K
from tidewatch import schemas

JSON_TIMES = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}
CORRUPT = "_corrupt_record"
HEAD = ("stream", "key", "partition", "offset", "ingest_time")


# --- readers ---------------------------------------------------------------
def kafka_options(
    servers: str,
    topics: Sequence[str] = K.STREAMS,
    starting: str = "latest",
    max_offsets: int | None = K.MAX_OFFSETS_PER_TRIGGER,
    pattern: str | None = None,
) -> dict[str, str]:
    """Options of a streaming read; `pattern` subscribes by name pattern."""
    options = {
        "kafka.bootstrap.servers": servers,
        "startingOffsets": starting,
        "failOnDataLoss": "false",
    }
    options["subscribePattern" if pattern else "subscribe"] = pattern or ",".join(topics)
    if max_offsets:
        options["maxOffsetsPerTrigger"] = str(max_offsets)
    return options


def from_kafka_rows(df: DataFrame) -> DataFrame:
    """Kafka's row layout as an envelope."""
    return df.select(
        F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
        F.col("topic").alias("stream"),
        F.col("partition").cast("int").alias("partition"),
        F.col("offset").cast("long").alias("offset"),
        F.col("timestamp").cast("timestamp").alias("ingest_time"),
    )


def stream_kafka(spark: SparkSession, **options) -> DataFrame:
    return from_kafka_rows(spark.readStream.format("kafka").options(**kafka_options(**options)).load())


def read_kafka(
    spark: SparkSession, servers: str, topics=K.STREAMS, starting="earliest", ending="latest"
) -> DataFrame:
    """A bounded read between two offset positions."""
    options = kafka_options(servers, topics, starting, None)
    options["endingOffsets"] = ending
    return from_kafka_rows(spark.read.format("kafka").options(**options).load())


def stream_files(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Envelopes as Parquet files, in order of arrival."""
    reader = spark.readStream.schema(schemas.ENVELOPE)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def subscribe(df: DataFrame, topics: Sequence[str]) -> DataFrame:
    return df.filter(F.col("stream").isin(*topics))


def consume_batch(df: DataFrame, batch_size: int = 100, tie: Sequence[str] = ()) -> DataFrame:
    """The first messages by stream, partition and offset, at most `batch_size`."""
    return df.orderBy("stream", "partition", "offset", *tie).limit(batch_size)


# --- decoding --------------------------------------------------------------
def _payload_columns() -> dict[str, list[str]]:
    """Payload column -> streams that carry it, in order of first appearance."""
    columns: dict[str, list[str]] = {}
    for stream, schema in schemas.PAYLOADS.items():
        for field in schema.fieldNames():
            columns.setdefault(field, []).append(stream)
    return columns


def _part(stream: str) -> str:
    return stream.replace("-", "_")


def _parse(df: DataFrame) -> DataFrame:
    """Parse each message with its own stream's schema, once: the others get a
    NULL text, which costs nothing to parse. A filter on the parsed fields
    would move below a plain projection and parse every message again, so the
    result comes out of a generator, which filters stay above."""
    parts = []
    for stream, schema in schemas.PAYLOADS.items():
        text = F.when(F.col("stream") == stream, F.col("value"))
        full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
        parts.append(F.from_json(text, full, options).alias(_part(stream)))
    return df.select("*", F.explode(F.array(F.struct(*parts))).alias("_parsed"))


def _first(streams: Sequence[str], field: str) -> Column:
    return F.coalesce(*[F.col(f"_parsed.{_part(stream)}.{field}") for stream in streams])


def problem() -> Column:
    """Why a parsed message is bad; NULL for a good one. One without a time would be
    in no window, no read by recency and no age rule, so it is bad."""
    return (
        F.when(~F.coalesce(F.col("stream").isin(*K.STREAMS), F.lit(False)), F.lit("unknown stream"))
        .when(F.col("value").isNull(), F.lit("no value"))
        .when(_first(K.STREAMS, CORRUPT).isNotNull(), F.lit("malformed value"))
        .when(_first(K.STREAMS, "timestamp").isNull(), F.lit("no time"))
    )


def parse(df: DataFrame) -> DataFrame:
    """All messages as one wide typed table; fields of other streams are NULL.
    `error` says what is wrong with a message, and `raw` is its text if so."""
    wide = [_first(streams, field).alias(field) for field, streams in _payload_columns().items()]
    error = problem()
    raw = F.when(error.isNotNull(), F.col("value")).alias("raw")
    return _parse(df).select(*HEAD, *wide, error.alias("error"), raw)


def good(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("error").isNull()).drop("error", "raw")


def bad(parsed: DataFrame) -> DataFrame:
    kept = [name for name in parsed.columns if name in (*HEAD, "created_at")]
    return parsed.filter(F.col("error").isNotNull()).select(*kept, F.col("raw").alias("value"), "error")


def decode(df: DataFrame) -> DataFrame:
    """The messages that can be decoded."""
    return good(parse(df))


def dead_letters(df: DataFrame) -> DataFrame:
    """The messages that cannot, whole, with the reason."""
    return bad(parse(df))


def decode_one(df: DataFrame, stream: str) -> DataFrame:
    """One stream's good messages with exactly its own fields; filtering the
    stream first keeps the others' text from being read into the parser. Those
    that `decode` leaves to the dead letters are left out here too."""
    schema = schemas.PAYLOADS[stream]
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    rows = df.filter((F.col("stream") == stream) & F.col("value").isNotNull())
    # out of a generator, for the same reason as above
    rows = rows.select(*HEAD, F.explode(F.array(parsed)).alias("_payload"))
    sound = F.col(f"_payload.{CORRUPT}").isNull() & F.col("_payload.timestamp").isNotNull()
    return rows.filter(sound).select(
        *HEAD, *[F.col(f"_payload.{name}").alias(name) for name in schema.fieldNames()]
    )


# --- encoding --------------------------------------------------------------
def message_key(df: DataFrame, column: str | None) -> Column:
    """A text key goes out as it is, empty text too; other keys go out as JSON,
    and those that are zero, false or empty not at all."""
    if column is None:
        return F.lit(None).cast("string")
    key, kind = F.col(column), df.schema[column].dataType
    if isinstance(kind, T.StringType):
        return key
    if isinstance(kind, T.BooleanType):
        return F.when(key, F.lit("true"))
    if isinstance(kind, T.NumericType):
        return F.when(key != 0, key.cast("string"))
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.when(F.size(key) > 0, F.to_json(key, JSON_TIMES))
    if isinstance(kind, T.StructType):
        return F.to_json(key, JSON_TIMES)
    return key.cast("string")


def as_json(columns: Sequence[str], keep_nulls: bool = True) -> Column:
    options = {**JSON_TIMES, "ignoreNullFields": str(not keep_nulls).lower()}
    return F.to_json(F.struct(*columns), options)


def encode(
    df: DataFrame,
    stream: str,
    key: str | None = None,
    fields: Sequence[str] | None = None,
    partition: Column | None = None,
    headers: Column | None = None,
) -> DataFrame:
    """Rows as messages: stream, key and JSON value, ready for `write_kafka`."""
    columns = [
        F.lit(stream).alias("stream"),
        message_key(df, key).alias("key"),
        as_json(fields or df.columns).alias("value"),
    ]
    if partition is not None:
        columns.append(partition.cast("int").alias("partition"))
    if headers is not None:
        columns.append(headers.alias("headers"))
    return df.select(*columns)


def json_feed(df: DataFrame) -> DataFrame:
    """Each whole row as one JSON value, without its NULL fields."""
    return df.select(as_json(df.columns, keep_nulls=False).alias("value"))


def write_kafka(df: DataFrame, servers: str) -> None:
    df.withColumnRenamed("stream", "topic").write.format("kafka").option(
        "kafka.bootstrap.servers", servers
    ).save()
