"""The three event tables and their message stream, derived from the given tables.

Each view is a plan over whole tables: every event is a sensor reading, every
event posts a document and every order line is a price update. Message
columns are derived too, so all operators have real input.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import constants as K
from tidewatch.operators import series
from tidewatch.sources import messages

# --- fixed values: which event types stand for which sensor types ---------
SENSOR_TYPE_OF = {
    "click": "temperature",
    "view": "humidity",
    "purchase": "pressure",
    "signup": "light",
    "error": "motion",
}

MARKET_ORDER = ["timestamp", "order_id", "line", "supplier", "volume", "total"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chosen(keys: Column, choices: dict) -> Column:
    cases = F
    for name, value in choices.items():
        cases = cases.when(keys == name, F.lit(value))
    return cases.otherwise(F.lit(None).cast("string"))


def sensor_from_events(events: DataFrame) -> DataFrame:
    """Sensor readings over a table, or a stream, of events."""
    kind = chosen(F.col("event_type"), SENSOR_TYPE_OF)
    unit = chosen(kind, {name: unit for name, _, _, unit in K.SENSOR_RANGES})
    place = F.element_at(
        F.array(*[F.lit(name) for name in K.LOCATIONS]), (F.col("user_id") % 5 + 1).cast("int")
    )
    return events.select(
        F.concat(F.lit("sensor-"), F.col("user_id").cast("string")).alias("sensor_id"),
        kind.alias("sensor_type"),
        place.alias("location"),
        F.col("ts").alias("timestamp"),
        F.when(kind == "temperature", F.col("value") * 0.5 - 10).otherwise(F.col("value")).alias("value"),
        unit.alias("unit"),
        (F.col("value") > 150).alias("is_anomaly"),
        F.lit(K.SENSOR_SOURCE).alias("source"),
        F.col("event_id").alias("id"),
    )


def sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensor_from_events(table(spark, sf_dir, "events"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event i posts document i modulo the number of documents. Both sides grow
    with the data and the texts are large: a merge join spreads them over the
    tasks, however few files the documents come in. Texts are measured before
    it, so a read of their length does not carry them along."""
    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    number = documents.select(F.count(F.lit(1))).scalar()
    events = table(spark, sf_dir, "events").withColumn("_document", F.col("event_id") % number)
    k = F.get_json_object("props", "$.k").cast("long")
    sentiment = (
        F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    )
    texts = documents.join(labels, "doc_id", "left").select(
        "doc_id",
        F.col("text").alias("content"),
        F.length("text").alias("content_length"),
        F.col("source").alias("topic"),
        sentiment.alias("sentiment"),
    )
    return events.join(texts.hint("merge"), F.col("_document") == F.col("doc_id")).select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("user_id"),
        F.col("ts").alias("timestamp"),
        "content",
        "content_length",
        "topic",
        "sentiment",
        (15 * k).alias("engagement_count"),
        (k >= 97).alias("is_anomaly"),
        F.lit(K.SOCIAL_SOURCE).alias("source"),
        F.col("event_id").alias("id"),
    )


def part_symbol(number: str) -> Column:
    return F.concat(F.lit("P"), F.col(number).cast("string"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks_of(table(spark, sf_dir, "lineitem"))


def ticks_of(lines: DataFrame) -> DataFrame:
    """Order lines as prices of parts. (order, line) is not unique, so
    MARKET_ORDER takes in more columns to tell all rows of a part apart."""
    return lines.select(
        F.col("l_partkey").alias("part_id"),
        part_symbol("l_partkey").alias("symbol"),
        F.round(F.col("l_extendedprice") / F.col("l_quantity"), 2).alias("price"),
        (F.col("l_quantity") * 400).cast("long").alias("volume"),
        F.col("l_shipdate").alias("timestamp"),
        F.lit(K.MARKET_SOURCE).alias("source"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_suppkey").alias("supplier"),
        F.col("l_extendedprice").alias("total"),
    )


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price updates: ticks with their change and their part's sector. A symbol is its
    part's number in other words; by the number, changes and sectors take one shuffle,
    which carries no texts."""
    numbers = ticks(spark, sf_dir).drop("symbol", "source")
    moved = series.price_change(numbers, "part_id", "price", MARKET_ORDER)
    moved = moved.withColumn("symbol", part_symbol("part_id"))
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("part_id"), F.col("p_type").alias("sector")
    )
    return moved.join(parts, "part_id").select(
        "symbol",
        F.concat(F.col("symbol"), F.lit(" Corporation")).alias("company_name"),
        "sector",
        "price",
        "price_change",
        "price_change_percent",
        "volume",
        "timestamp",
        (F.abs(F.col("price_change_percent")) > 500).alias("is_anomaly"),
        F.lit(K.MARKET_SOURCE).alias("source"),
        "order_id",
        "line",
        "supplier",
        "total",
    )


def _message(df: DataFrame, stream: str, key: str, number: Column) -> DataFrame:
    from tidewatch.schemas import PAYLOADS

    fields = PAYLOADS[stream].fieldNames()
    return df.select(
        F.col(key).alias("key"),
        messages.as_json(fields).alias("value"),
        F.lit(stream).alias("stream"),
        (number % 4).cast("int").alias("partition"),
        number.alias("offset"),
        (F.col("timestamp") + F.expr("interval 2 seconds")).alias("ingest_time"),
    )


def envelopes(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Each of the three tables as messages, two seconds behind event time."""
    number = F.col("order_id") * 10 + F.col("line")
    return [
        _message(sensors(spark, sf_dir), K.SENSOR_STREAM, "sensor_id", F.col("id")),
        _message(posts(spark, sf_dir), K.SOCIAL_STREAM, "user_id", F.col("id")),
        _message(market(spark, sf_dir), K.MARKET_STREAM, "symbol", number),
    ]


def envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three tables as one message stream."""
    first, *others = envelopes(spark, sf_dir)
    for part in others:
        first = first.unionByName(part)
    return first


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decoded stream: all three tables widened into one."""
    tables = [
        (K.SENSOR_STREAM, sensors(spark, sf_dir).drop("id")),
        (K.SOCIAL_STREAM, posts(spark, sf_dir).drop("id")),
        (K.MARKET_STREAM, market(spark, sf_dir).drop("order_id", "line", "supplier", "total")),
    ]
    parts = [df.withColumn("stream", F.lit(stream)) for stream, df in tables]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole
