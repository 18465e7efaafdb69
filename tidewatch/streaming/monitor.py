"""What streaming queries report of themselves, added up batch by batch and kept as a table."""

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tidewatch.sources import tables

COLUMNS = "query string, run string, batch long, rows long, dropped_late long, failure string, timestamp timestamp"


class Monitor(StreamingQueryListener):
    """Counts the rows that each batch read and dropped as late, and failures, of all queries of a session.

    A query keeps its own progress for its last batches only; here every batch counts, once
    however often it is reported.
    """

    def __init__(self) -> None:
        self._batches: dict[tuple[str, int], tuple] = {}
        self._unsaved: set[tuple[str, int]] = set()
        self._ended: dict[str, threading.Event] = {}
        self._lock = threading.Lock()

    def _end(self, run: str) -> threading.Event:
        with self._lock:
            return self._ended.setdefault(run, threading.Event())

    def _count(self, query: str, run: str, batch: int, rows: int, dropped: int, failure: str | None, time: str) -> None:
        with self._lock:
            self._batches[run, batch] = (query, run, batch, rows, dropped, failure, time)
            self._unsaved.add((run, batch))

    def onQueryStarted(self, event) -> None:
        self._end(str(event.runId))

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        dropped = sum(operator.numRowsDroppedByWatermark for operator in progress.stateOperators)
        self._count(
            progress.name or str(progress.id), str(progress.runId), progress.batchId, progress.numInputRows, dropped, None,
            progress.timestamp,
        )

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self._count(str(event.id), str(event.runId), -1, 0, 0, event.exception, None)
        self._end(str(event.runId)).set()

    def wait(self, query: StreamingQuery, seconds: float = 60) -> bool:
        """Wait until all reports of an ended query have come."""
        return self._end(str(query.runId)).wait(seconds)

    def dropped_late(self, query: StreamingQuery) -> int:
        """Rows of all batches of a query's run that came after their window had closed."""
        with self._lock:
            return sum(row[4] for (run, _), row in self._batches.items() if run == str(query.runId))

    def save(self, spark: SparkSession, path: str) -> None:
        """Append what was not saved yet to a stored table."""
        with self._lock:
            keys, self._unsaved = self._unsaved, set()
            rows = [self._batches[key] for key in keys]
        if rows:
            text = COLUMNS.replace("timestamp timestamp", "timestamp string")
            made = spark.createDataFrame(rows, text)
            tables.insert(made.withColumn("timestamp", made["timestamp"].cast("timestamp")), path)


def totals(spark: SparkSession, path: str) -> DataFrame:
    """Rows read, rows dropped and failures of each query, over all its runs."""
    return tables.read(spark, path).groupBy("query").agg({"rows": "sum", "dropped_late": "sum", "failure": "count"})
