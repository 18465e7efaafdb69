"""Per-source enrichment, alone and for the mixed stream in a single pass."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch import constants as K
from tidewatch.functions import ladders
from tidewatch.functions.clock import delay_ms, moment


def derived_columns(df: DataFrame) -> dict:
    """The columns each stream gains, as expressions over its own fields; a
    length that the table has already is kept."""
    length = F.col("content_length") if "content_length" in df.columns else F.length("content")
    return {
        K.SENSOR_STREAM: {"reading_category": ladders.reading_category()},
        K.SOCIAL_STREAM: {
            "content_length": length,
            "engagement_level": ladders.engagement_level(),
        },
        K.MARKET_STREAM: {
            "price_movement": ladders.price_movement(),
            "trading_activity": ladders.trading_activity(),
        },
    }


def stamp(df: DataFrame, as_of=None, exact: bool = False) -> DataFrame:
    """Processing time and the delay since the event."""
    timed = df.withColumn("processing_time", moment(as_of))
    return timed.withColumn(
        "processing_delay_ms", delay_ms(F.col("processing_time"), F.col("timestamp"), exact)
    )


def enrich_source(df: DataFrame, stream: str, as_of=None) -> DataFrame:
    """Enrich a table that holds one kind of record."""
    return stamp(df, as_of).withColumns(derived_columns(df)[stream])


def route(df: DataFrame, stream: str) -> DataFrame:
    return df.filter(F.col("stream") == stream)


def enrich_all(df: DataFrame, as_of=None) -> DataFrame:
    """Enrich the mixed table. Each row gains its own stream's columns, the
    others stay NULL: the widened union of the three, from one scan."""
    known = stamp(df.filter(F.col("stream").isin(*K.STREAMS)), as_of)
    added = {
        name: F.when(F.col("stream") == stream, column)
        for stream, columns in derived_columns(df).items()
        for name, column in columns.items()
    }
    return known.withColumns(added)
