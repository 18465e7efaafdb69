"""Scoring and cooldown as two stateful steps of one streaming query.

Spark lets only one `applyInPandasWithState` into a query; processors with state
variables and timers can follow each other, if the first names the event time of what
it puts out. Their state is kept by the RocksDB state store.
"""

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from tidewatch import constants as K
from tidewatch.operators.detect import number, with_key
from tidewatch.session import ship_package
from tidewatch.streaming.state import in_order, passes, rising, zscores

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def places(names: Sequence[str]) -> dict[str, str]:
    """Plain names for columns on their way to Python, where Spark loses names that cannot be attributes."""
    return {name: f"c{place}" for place, name in enumerate(names)}


def renamed(df: DataFrame, names: dict[str, str], extra: Column) -> DataFrame:
    return df.select(*(F.col(f"`{name}`").alias(plain) for name, plain in names.items()), extra)


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB; the session's own setting comes back after."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


class Scorer(StatefulProcessor):
    """Z-scores of a key's rows against its last numbers, which are a list of the state."""

    def __init__(self, columns: list[str], time: str, window_size: int, threshold: float):
        self.columns, self.time, self.window_size, self.threshold = columns, time, window_size, threshold

    def init(self, handle) -> None:
        self.held = handle.getListState("held", T.StructType().add("value", T.DoubleType()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = np.array([value for (value,) in self.held.get()], dtype=float)
        for batch in rising(rows, self.time):
            counts = batch["number"].notna().to_numpy()
            values = np.concatenate([held, batch["number"].to_numpy(dtype=float)[counts]])
            found, flagged = zscores(values, self.window_size, self.threshold)
            score, flag = np.zeros(len(batch)), np.zeros(len(batch), bool)
            score[counts], flag[counts] = found[len(held) :], flagged[len(held) :]
            held = values[-self.window_size :]
            yield batch[self.columns].assign(anomaly_score=score, is_anomaly=flag)
        if len(held):
            self.held.put([(float(value),) for value in held])

    def close(self) -> None:
        pass


class Cooldown(StatefulProcessor):
    """The rows of a key that are sent; a timer forgets the key when its cooldown is over."""

    def __init__(self, columns: list[str], gap: int):
        self.columns, self.gap = columns, gap

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last_sent", T.StructType().add("micros", T.LongType()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = free_from = self.last.get()[0] + self.gap if self.last.exists() else None
        for batch in rising(rows, "micros"):
            sent, free_from = passes(batch["micros"].to_numpy(), free_from, self.gap)
            if sent:
                yield batch.iloc[sent][self.columns]
        if free_from != before:
            self.last.update((free_from - self.gap,))
            self.handle.registerTimer(max(free_from // 1000, timerValues.getCurrentWatermarkInMs()) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # Every sent row set a timer; only that of the last one ends the cooldown.
        if self.last.exists() and (self.last.get()[0] + self.gap) // 1000 < timerValues.getCurrentWatermarkInMs():
            self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def score_events(
    df: DataFrame,
    key: str,
    value: str,
    order: Sequence[str],
    window_size: int = K.DETECTOR_WINDOW,
    threshold: float = K.Z_THRESHOLD,
    watermark: str = K.WATERMARK,
) -> DataFrame:
    """`score_stream` with z-scores, for another stateful step to follow.

    `order[0]` is the event time. Rows later than the watermark are dropped, as are rows
    without a time: they would have no place in the cooldown.
    """
    ship_package(df.sparkSession)
    time, columns = order[0], [name for name in df.columns if name not in ("anomaly_score", "is_anomaly")]
    names = places(columns)
    timed = with_key(df, key).where(F.col(time).isNotNull()).withWatermark(time, watermark)
    rows = in_order(renamed(timed, names, number(value).alias("number")), names[key], [names[name] for name in order])
    schema = T.StructType([T.StructField(names[name], df.schema[name].dataType) for name in columns])
    schema = schema.add("anomaly_score", "double").add("is_anomaly", "boolean")
    scorer = Scorer(list(names.values()), names[time], window_size, threshold)
    scored = rows.groupBy(names[key]).transformWithStateInPandas(
        scorer, schema, "append", "eventTime", eventTimeColumnName=names[time]
    )
    return scored.toDF(*columns, "anomaly_score", "is_anomaly")


def cooled_down(alerts: DataFrame, key: str, order: Sequence[str], minutes: float = K.COOLDOWN_MINUTES) -> DataFrame:
    """`cooldown_stream` on rows that a stateful step before it puts out, under that step's watermark."""
    ship_package(alerts.sparkSession)
    names = places(alerts.columns)
    plain = renamed(alerts, names, F.unix_micros(order[0]).alias("micros"))
    rows = in_order(plain, names[key], ["micros", *(names[name] for name in order[1:])])
    schema = T.StructType([T.StructField(plain, alerts.schema[name].dataType) for name, plain in names.items()])
    processor = Cooldown(list(names.values()), int(minutes * 60_000_000))
    sent = rows.groupBy(names[key]).transformWithStateInPandas(processor, schema, "append", "eventTime")
    return sent.toDF(*alerts.columns)
