"""Keyed state across micro-batches: detectors and the alert cooldown.

Spark deals the stream out by key, sorts a micro-batch within its partitions and hands
each key's rows to these functions in order, an Arrow batch at a time, with the key's
state. However many rows a key has, Python holds one such batch and the state, which is
bounded by the detector window or the cooldown.
"""

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from tidewatch import constants as K
from tidewatch.operators.detect import exceeds, number, with_key
from tidewatch.session import ship_package

ROWS_AT_ONCE = 8192
CHECK = "spark.sql.streaming.unsupportedOperationCheck"


def in_order(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Each micro-batch dealt out by key and sorted by key and order, NULL last, for a stateful step on the key.

    Spark spills what a task cannot hold. Its check of streaming plans knows no sort
    within the partitions of a micro-batch and refuses any sort, as a stream has no end,
    so the check is off in this session from here on. A checkpoint keeps its number of
    partitions: if the session's is another one, Spark deals the rows out once more, which
    keeps each key's order unless a task spills there; `rising` tells.
    """
    rows.sparkSession.conf.set(CHECK, "false")
    return rows.repartition(key).sortWithinPartitions(key, *[F.asc_nulls_last(name) for name in order])


def rising(frames: Iterator[pd.DataFrame], time: str) -> Iterator[pd.DataFrame]:
    """The frames as they are; an error if a key's rows do not come in order, which scores rely on."""
    latest = None
    for frame in frames:
        times = frame[time].dropna()
        if not times.is_monotonic_increasing or (latest is not None and len(times) and times.iloc[0] < latest):
            raise RuntimeError(f"rows of a key came out of the order of {time}: give the session the checkpoint's spark.sql.shuffle.partitions")
        latest = times.iloc[-1] if len(times) else latest
        yield frame


def trailing(values: np.ndarray, width: int, reduce, minimum: int = 1) -> np.ndarray:
    """`reduce` over the last `width` values at each place, NaN below `minimum`."""
    out = np.full(len(values), np.nan)
    for end in range(minimum, min(width, len(values) + 1)):
        out[end - 1] = reduce(values[:end])
    if len(values) >= width:
        frames = np.lib.stride_tricks.sliding_window_view(values, width)
        for at in range(0, len(frames), ROWS_AT_ONCE):
            part = frames[at : at + ROWS_AT_ONCE]
            out[width - 1 + at : width - 1 + at + len(part)] = reduce(part, axis=1)
    return out


def zscores(values: np.ndarray, window_size: int, threshold: float):
    mean = trailing(values, window_size, np.mean)
    spread = np.where(
        trailing(values, window_size, np.ptp) == 0, 0.0, trailing(values, window_size, np.std)
    )
    seen = np.minimum(np.arange(1, len(values) + 1), window_size)
    ready = (seen >= K.MIN_VALUES) & (spread != 0)
    score = np.zeros(len(values))
    score[ready] = np.abs((values[ready] - mean[ready]) / spread[ready])
    return score, exceeds(score, threshold)


def deviations(values: np.ndarray, window_size: int, ma_window: int):
    seen = np.minimum(np.arange(1, len(values) + 1), window_size)
    mean = trailing(values, ma_window, np.mean, ma_window)
    known = mean[ma_window - 1 :]
    spread = np.full(len(values), np.nan)
    if len(known) > 1:
        spread[ma_window:] = trailing(known[:-1], max(window_size - ma_window, 1), np.std)
    with np.errstate(divide="ignore", invalid="ignore"):
        deviation = np.abs(values - mean)
        limit = np.where(seen >= 2 * ma_window, K.MA_VOLATILITY_FACTOR * spread, K.MA_WARMUP_SHARE * mean)
        ready = seen >= ma_window
        score = np.where(ready, np.where(mean == 0, np.nan, deviation / mean), 0.0)
        return score, ready & exceeds(deviation, limit)


def score_stream(
    df: DataFrame,
    key: str,
    value: str,
    order: Sequence[str],
    method: str = "zscore",
    window_size: int = K.DETECTOR_WINDOW,
    threshold: float = K.Z_THRESHOLD,
    ma_window: int = K.MA_WINDOW,
) -> DataFrame:
    """Score a stream with `zscore` or `moving_average`. Rows of a micro-batch
    are taken in `order`; rows that come in a later one are scored on arrival."""
    ship_package(df.sparkSession)
    rows = in_order(with_key(df, key).withColumn("_number", number(value)), key, order)
    columns = [name for name in df.columns if name not in ("anomaly_score", "is_anomaly")]
    schema = T.StructType([df.schema[name] for name in columns])
    schema = schema.add("anomaly_score", "double").add("is_anomaly", "boolean")
    buffer = T.StructType().add("values", T.ArrayType(T.DoubleType()))

    def update(name, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = np.array(state.get[0] if state.exists else [], dtype=float)
        for batch in rising(frames, order[0]):
            counts = batch["_number"].notna().to_numpy()
            values = np.concatenate([held, batch["_number"].to_numpy(dtype=float)[counts]])
            if method == "zscore":
                found, flagged = zscores(values, window_size, threshold)
            else:
                found, flagged = deviations(values, window_size, ma_window)
            score, flag = np.zeros(len(batch)), np.zeros(len(batch), bool)
            score[counts], flag[counts] = found[len(held) :], flagged[len(held) :]
            held = values[-window_size:]
            yield batch[columns].assign(anomaly_score=score, is_anomaly=flag)
        state.update((held.tolist(),))

    return rows.groupBy(key).applyInPandasWithState(update, schema, buffer, "append", GroupStateTimeout.NoTimeout)


def passes(micros: np.ndarray, free_from: int | None, gap: int) -> tuple[list[int], int]:
    """Places of the rising times that are sent, and when the next may be; None: from the first."""
    free_from = micros[0] if free_from is None else free_from
    sent, at = [], int(np.searchsorted(micros, free_from))
    while at < len(micros):
        sent.append(at)
        free_from = int(micros[at]) + gap
        at = max(int(np.searchsorted(micros, free_from)), at + 1)
    return sent, free_from


def cooldown_stream(
    alerts: DataFrame,
    key: str,
    order: Sequence[str],
    minutes: float = K.COOLDOWN_MINUTES,
    watermark: str = K.WATERMARK,
) -> DataFrame:
    """The alerts of a stream that are sent: the first of a key, and then those
    at least the cooldown after the last sent one. State of a key is dropped
    when the watermark passes the end of its cooldown."""
    ship_package(alerts.sparkSession)
    gap = int(minutes * 60_000_000)
    time = order[0]
    last = T.StructType().add("last_sent", "long")
    timed = alerts.withWatermark(time, watermark).withColumn("_micros", F.unix_micros(time))
    rows = in_order(timed, key, ["_micros", *order[1:]])
    columns = alerts.columns

    def update(name, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        free_from = state.get[0] + gap if state.exists else None
        for batch in rising(frames, "_micros"):
            sent, free_from = passes(batch["_micros"].to_numpy(), free_from, gap)
            if sent:
                state.update((free_from - gap,))
                yield batch.iloc[sent][columns]
        expiry = free_from // 1000 + 1
        if expiry > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(expiry)
        else:
            state.remove()

    return rows.groupBy(key).applyInPandasWithState(
        update, alerts.schema, last, "append", GroupStateTimeout.EventTimeTimeout
    )
