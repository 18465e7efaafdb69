"""Sinks of the streaming job."""

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tidewatch import constants as K
from tidewatch.operators.lifecycle import with_created
from tidewatch.operators.series import latest_per_key
from tidewatch.sources import messages, tables


def triggered(writer: DataStreamWriter, trigger: dict | None) -> DataStreamWriter:
    return writer.trigger(**(trigger or {"processingTime": K.TRIGGER}))


def table_sink(
    df: DataFrame,
    path: str,
    checkpoint: str,
    time: str = "timestamp",
    trigger: dict | None = None,
    backfill: bool = False,
) -> StreamingQuery:
    """Append each micro-batch to a stored table, once even after a restart."""

    def store(batch: DataFrame, batch_id: int) -> None:
        tables.write_batch(batch, batch_id, path, time, backfill)

    writer = with_created(df).writeStream.outputMode("append").foreachBatch(store)
    return triggered(writer.option("checkpointLocation", checkpoint), trigger).start()


def latest_sink(
    df: DataFrame, path: str, key: str, order: Sequence[str], checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Keep a stored table of the last row of each key along `order`.

    A micro-batch is reduced to one row a key; the files that hold these keys are
    rewritten with the later of both, in one version. A repeated batch changes nothing.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        changes = latest_per_key(batch, [key], order).persist()
        try:
            if tables.listed(spark, path):
                tables.merge_files(
                    spark, path, changes, key, lambda rows: latest_per_key(rows.unionByName(changes, True), [key], order)
                )
            else:
                tables.insert(changes.repartitionByRange(key), path, order[0], keys=[key])
        finally:
            changes.unpersist()

    writer = with_created(df).writeStream.outputMode("append").foreachBatch(store)
    return triggered(writer.option("checkpointLocation", checkpoint), trigger).start()


def fan_out_sink(
    df: DataFrame,
    write_parts: Callable[[DataFrame, int], None],
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Feed several sinks from one stream. A micro-batch is read and computed anew each
    time that `write_parts` uses it: a copy kept meanwhile would take as much of the
    executors' disks as all that is written of it."""
    writer = with_created(df).writeStream.outputMode("append").foreachBatch(write_parts)
    return triggered(writer.option("checkpointLocation", checkpoint), trigger).start()


def write_feed(df: DataFrame, batch_id: int, path: str) -> None:
    """JSON messages of a micro-batch as gzipped text files, for sites without a broker."""
    messages.json_feed(df).write.mode("overwrite").option("compression", "gzip").text(f"{path}/batch_id={batch_id}")


def send_feed(df: DataFrame, servers: str, topic: str) -> None:
    """JSON messages of a micro-batch to a topic; a repeated batch sends again."""
    feed = messages.json_feed(df).write.format("kafka")
    feed.option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def kafka_sink(
    df: DataFrame, servers: str, topic: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Each row as a JSON message of a topic."""
    writer = (
        messages.json_feed(df)
        .writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
    )
    return triggered(writer, trigger).start()


def file_sink(df: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Rows as Parquet files that another stream can follow, each row once."""
    writer = df.writeStream.format("parquet").option("path", path)
    return triggered(writer.option("checkpointLocation", checkpoint), trigger).start()
