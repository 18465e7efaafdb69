"""Trailing-window detectors over per-key series, in built-in window functions."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch import constants as K
from tidewatch.operators.series import BLOCK, BLOCK_ROWS, POSITION, drop_carried, in_blocks

# Rounding may put a score that equals its limit on either side of it; what lies
# within this share of the limit counts as equal to it, on tables and on streams.
ROUNDING = 1e-9


def with_key(df: DataFrame, key: str) -> DataFrame:
    """Rows that name a key: not NULL and not the empty text."""
    keyed = F.col(key).isNotNull()
    if isinstance(df.schema[key].dataType, T.StringType):
        keyed = keyed & (F.col(key) != "")
    return df.filter(keyed)


def number(value: str) -> Column:
    """The value as a double; text that is no number and NaN become NULL."""
    parsed = F.col(value).try_cast("double")
    return F.when(~F.isnan(parsed), parsed)


def exceeds(value, limit):
    """Whether a value is beyond its limit by more than rounding; columns and arrays alike."""
    return value - limit > ROUNDING * (F.abs(limit) if isinstance(limit, Column) else abs(limit))


def _numbered(df, key, value, order, lookback, align, block_rows):
    """Blocks in which rows without a number form a series of their own, so
    they take no place in the frames of the others and need no second scan."""
    rows = with_key(df, key).withColumn("_number", number(value))
    rows = rows.withColumn("_counts", F.col("_number").isNotNull())
    return in_blocks(rows, [key, "_counts"], order, lookback, align, block_rows)


def _series(key: str) -> list[str]:
    return [key, "_counts", BLOCK]


def trailing_moments(
    df: DataFrame, series: Sequence[str], order: Sequence[str], value: str, width: int
) -> DataFrame:
    """Mean and population deviation (`_mean`, `_spread`) of the last `width`
    rows up to each row, at a cost per row that does not grow with `width`.

    A sliding frame would add up `width` values for every row. Cut each series
    into segments of `width` rows instead: a frame is then the newest part of
    one segment and the oldest part of the next, and both come from running
    aggregates, the former along the reversed order. Running variances are
    combined by their means, so nothing cancels out; equal values are told by
    their minimum and maximum and have a deviation of exactly 0.
    """
    cut = df.withColumn("_segment", F.floor((F.col(POSITION) - 1) / width).cast("long"))
    whole = Window.partitionBy(*series).orderBy("_segment", *order)
    segment = Window.partitionBy(*series, "_segment")
    backward = segment.orderBy(*[F.desc(name) for name in order]).rowsBetween(Window.unboundedPreceding, 0)
    forward = segment.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)

    def running(window) -> Column:
        return F.struct(
            F.count(value).over(window).alias("n"),
            F.avg(value).over(window).alias("mean"),
            F.var_pop(value).over(window).alias("variance"),
            F.min(value).over(window).alias("low"),
            F.max(value).over(window).alias("high"),
        )

    # the last row of a segment has its whole frame in that segment
    crosses = F.col(POSITION) % width != 0
    rest = F.when(crosses, F.lag("_rest", width - 1).over(whole))
    parts = cut.withColumn("_rest", running(backward)).withColumns({"_rest": rest, "_part": running(forward)})
    old, new = F.col("_rest"), F.col("_part")
    old_n, new_n = F.coalesce(old.n, F.lit(0)), new.n
    total = old_n + new_n
    apart = old.mean - new.mean
    both = (old_n > 0) & (new_n > 0)
    mean = F.when(both, new.mean + apart * old_n / total).otherwise(F.coalesce(new.mean, old.mean))
    squares = (
        F.coalesce(old.variance * old_n, F.lit(0.0))
        + F.coalesce(new.variance * new_n, F.lit(0.0))
        + F.when(both, apart * apart * old_n * new_n / total).otherwise(0.0)
    )
    equal = F.least(old.low, new.low) == F.greatest(old.high, new.high)
    spread = F.when(equal, 0.0).when(total > 0, F.sqrt(squares / F.greatest(total, F.lit(1))))
    return parts.withColumns({"_mean": mean, "_spread": spread}).drop("_segment", "_rest", "_part")


def _finish(df: DataFrame, score: Column, flag: Column) -> DataFrame:
    scored = df.withColumns({"anomaly_score": score, "is_anomaly": flag})
    helpers = ("_number", "_counts", "_mean", "_spread", "_average", "_earlier", POSITION)
    return drop_carried(scored).drop(*helpers)


def zscore(
    df: DataFrame,
    key: str,
    value: str,
    order: Sequence[str],
    window_size: int = K.DETECTOR_WINDOW,
    threshold: float = K.Z_THRESHOLD,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Score each value against its key's last `window_size` numbers, itself
    included. Below ten numbers, and for rows without one, the score is 0."""
    rows = _numbered(df, key, value, order, window_size - 1, window_size, block_rows)
    rows = trailing_moments(rows, _series(key), order, "_number", window_size)
    seen = F.least(F.col(POSITION), F.lit(window_size))
    ready = F.col("_counts") & (seen >= K.MIN_VALUES)
    distance = F.when(
        F.col("_spread") != 0, F.abs((F.col("_number") - F.col("_mean")) / F.col("_spread"))
    ).otherwise(0.0)
    score = F.when(ready, distance).otherwise(F.lit(0.0))
    return _finish(rows, score, exceeds(score, threshold))


def moving_average(
    df: DataFrame,
    key: str,
    value: str,
    order: Sequence[str],
    ma_window: int = K.MA_WINDOW,
    window_size: int = K.DETECTOR_WINDOW,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Compare each value with the mean of its key's last `ma_window` numbers.

    The deviation may reach three deviations of the earlier means among the
    last `window_size` numbers, or a fifth of the mean while they are few.
    The score is the deviation's share of the mean, NULL for a mean of 0.
    """
    window = Window.partitionBy(*_series(key)).orderBy(*order)
    recent = window.rowsBetween(-(ma_window - 1), 0)
    width = max(window_size - ma_window, 1)
    rows = _numbered(df, key, value, order, window_size - 1, width, block_rows)
    average = F.when(F.col(POSITION) >= ma_window, F.avg("_number").over(recent))
    rows = rows.withColumn("_average", average)
    rows = rows.withColumn("_earlier", F.lag("_average").over(window))
    rows = trailing_moments(rows, _series(key), order, "_earlier", width)
    seen = F.least(F.col(POSITION), F.lit(window_size))
    deviation = F.abs(F.col("_number") - F.col("_average"))
    limit = F.when(seen >= 2 * ma_window, K.MA_VOLATILITY_FACTOR * F.col("_spread")).otherwise(
        K.MA_WARMUP_SHARE * F.col("_average")
    )
    ready = F.col("_counts") & (seen >= ma_window)
    score = F.when(ready, F.try_divide(deviation, F.col("_average"))).otherwise(F.lit(0.0))
    return _finish(rows, score, F.when(ready, exceeds(deviation, limit)).otherwise(F.lit(False)))


def range_check(df: DataFrame, sensor_type: str = "sensor_type", value: str = "value") -> DataFrame:
    """Look up the normal range and unit of each reading's type and flag values
    outside it. The ranges are five fixed rows, so they are sent to every task."""
    schema = "sensor_type string, lower double, upper double, unit string"
    ranges = df.sparkSession.createDataFrame(K.SENSOR_RANGES, schema)
    found = df.drop("unit", "lower", "upper").join(
        F.broadcast(ranges.withColumnRenamed("sensor_type", "_type")),
        F.col(sensor_type) == F.col("_type"),
        "left",
    )
    reading = F.when(F.col(sensor_type) == "motion", (F.col(value) > 0.5).cast("double")).otherwise(F.col(value))
    return found.drop("_type").withColumns(
        {"reading": reading, "out_of_range": ~reading.between(F.col("lower"), F.col("upper"))}
    )
