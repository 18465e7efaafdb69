"""Alerting on a stream: score, keep severe anomalies, cool down, write alerts.

Scoring and cooldown both keep state by key. `start_chained` does both in one query.
`start_scoring` and `start_alerts` are two queries with a folder of severe anomalies
between, which others can read too.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidewatch import constants as K
from tidewatch.operators.alerts import Z_AT_FULL_SEVERITY, candidates, severity_of_score, with_message
from tidewatch.operators.cooldown import alert_key
from tidewatch.sources import files
from tidewatch.streaming import chained, sinks
from tidewatch.streaming.state import cooldown_stream, score_stream


def severe(
    stream: DataFrame,
    key: str,
    value: str,
    order: Sequence[str],
    min_severity: float = K.MIN_SEVERITY,
    full: float = Z_AT_FULL_SEVERITY,
    **detector,
) -> DataFrame:
    """Flagged rows of a scored stream that are severe enough to alert on."""
    return _severe(score_stream(stream, key, value, order, **detector), key, min_severity, full)


def _severe(scored: DataFrame, key: str, min_severity: float, full: float) -> DataFrame:
    flagged = scored.filter(F.col("is_anomaly")).withColumn("severity", severity_of_score(full=full))
    return candidates(flagged, min_severity).withColumn("alert_key", alert_key("source", key))


def start_scoring(
    rows: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> tuple[StreamingQuery, T.StructType]:
    """Write the severe rows to a folder; returns the query and their schema."""
    files.make_folder(rows.sparkSession, path)
    return sinks.file_sink(rows, path, checkpoint, trigger), rows.schema


def start_alerts(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    order: Sequence[str],
    table: str,
    checkpoint: str,
    minutes: float = K.COOLDOWN_MINUTES,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Follow the folder of severe rows and store the alerts that are sent."""
    rows = spark.readStream.schema(schema).parquet(path)
    sent = with_message(cooldown_stream(rows, "alert_key", order, minutes))
    return sinks.table_sink(sent, table, checkpoint, trigger=trigger)


def start_chained(
    stream: DataFrame,
    key: str,
    value: str,
    order: Sequence[str],
    table: str,
    checkpoint: str,
    minutes: float = K.COOLDOWN_MINUTES,
    min_severity: float = K.MIN_SEVERITY,
    full: float = Z_AT_FULL_SEVERITY,
    trigger: dict | None = None,
    **detector,
) -> StreamingQuery:
    """Score, cool down and store the alerts that are sent, in one streaming query.

    Rows without a time and rows later than the watermark are not scored.
    """
    rows = _severe(chained.score_events(stream, key, value, order, **detector), key, min_severity, full)
    sent = with_message(chained.cooled_down(rows, "alert_key", order, minutes))
    with chained.rocksdb_state(stream.sparkSession):
        return sinks.table_sink(sent, table, checkpoint, order[0], trigger)
