"""The streaming job: decode, enrich, summarise, and feed the sinks."""

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch import constants as K
from tidewatch.operators.enrich import enrich_all
from tidewatch.operators.reads import flagged
from tidewatch.operators.rollup import summarise_all
from tidewatch.sources import messages, tables, versions
from tidewatch.streaming import sinks


def start_job(
    envelope: DataFrame,
    root: str,
    checkpoints: str,
    trigger: dict | None = None,
    kafka_servers: str | None = None,
    backfill: bool = False,
) -> dict[str, StreamingQuery]:
    """Start the job over a message stream and return its queries by name.

    - events: reads and parses each message once and writes the enriched rows; the
      flagged ones come from the files just stored, and these again as JSON messages.
      A micro-batch is not kept beside them: only one that holds messages that cannot
      be decoded is read and parsed once more, for these;
    - aggregated: one-minute summaries, emitted when the watermark closes them.

    Each query has its own checkpoint and continues from it after a restart.
    `backfill` is for batches that cover many months.
    """

    def write_parts(batch: DataFrame, batch_id: int) -> None:
        spark, seen = batch.sparkSession, Observation()
        counted = batch.observe(seen, F.count_if(F.col("error").isNotNull()).alias("bad"))
        enriched = enrich_all(messages.good(counted), F.col("created_at"))
        added = tables.write_batch(enriched, batch_id, f"{root}/processed_data", backfill=backfill)
        anomalies = flagged(versions.read_files(spark, enriched.schema, added))
        stored = tables.write_batch(anomalies, batch_id, f"{root}/anomalies", backfill=backfill)
        bad = messages.bad(batch)
        if added and not seen.get["bad"]:  # without any good row the count may have been planned away
            bad = bad.limit(0)
        tables.write_batch(bad, batch_id, f"{root}/{K.ERROR_STREAM}", "ingest_time")
        feed = versions.read_files(spark, anomalies.schema, stored).drop("created_at")
        if kafka_servers:
            sinks.send_feed(feed, kafka_servers, K.ANOMALY_STREAM)
        else:
            sinks.write_feed(feed, batch_id, f"{root}/{K.ANOMALY_STREAM}")

    summaries = summarise_all(messages.decode(envelope), watermark=K.WATERMARK)
    return {
        "events": sinks.fan_out_sink(messages.parse(envelope), write_parts, f"{checkpoints}/events", trigger),
        "aggregated": sinks.table_sink(
            summaries, f"{root}/aggregated_data", f"{checkpoints}/aggregated", "window_start", trigger, backfill
        ),
    }


def await_all(spark: SparkSession, queries: dict[str, StreamingQuery]) -> None:
    """Wait until all queries end; the first failure stops the others. Only these count:
    the session also tells of other queries, among them ones that failed before."""
    try:
        while not all([query.awaitTermination(1) for query in queries.values()]):
            pass
    finally:
        stop_all(queries)


def stop_all(queries: dict[str, StreamingQuery]) -> None:
    """Stop between triggers: no batch is cut short by the stop itself."""
    for query in queries.values():
        if query.isActive:
            query.stop()


def dropped_late_rows(query: StreamingQuery) -> int:
    """Rows that came after their window had closed, over the kept progress."""
    return sum(
        operator["numRowsDroppedByWatermark"]
        for progress in query.recentProgress
        for operator in progress["stateOperators"]
    )
