"""Tumbling-window summaries.

Every measure is a declarative aggregate, so Spark combines map-side before
the shuffle and a hot group key costs one partial row per task and window.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import constants as K


def anomalies() -> Column:
    """How many rows are flagged; rows without a flag count as not flagged."""
    return F.count_if(F.coalesce(F.col("is_anomaly"), F.lit(False)))


# stream -> group keys, measures, name of the row count
def _plans() -> dict:
    return {
        K.SENSOR_STREAM: (
            ["sensor_type", "location"],
            {
                "avg_value": F.avg("value"),
                "min_value": F.min("value"),
                "max_value": F.max("value"),
                "stddev_value": F.stddev_samp("value"),
            },
            "reading_count",
        ),
        K.SOCIAL_STREAM: (
            ["topic", "sentiment"],
            {
                "avg_engagement": F.avg("engagement_count"),
                "max_engagement": F.max("engagement_count"),
            },
            "post_count",
        ),
        K.MARKET_STREAM: (
            ["sector"],
            {
                "avg_price": F.avg("price"),
                "avg_price_change_pct": F.avg("price_change_percent"),
                "total_volume": F.sum("volume"),
            },
            "update_count",
        ),
    }


def _bounds() -> list[Column]:
    return [F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end")]


def summarise(df: DataFrame, stream: str, duration: str = K.WINDOW) -> DataFrame:
    """One stream's windows: measures, row count, flagged rows and their share."""
    keys, measures, rows = _plans()[stream]
    grouped = df.groupBy(F.window("timestamp", duration), *keys).agg(
        *[column.alias(name) for name, column in measures.items()],
        F.count(F.lit(1)).alias(rows),
        anomalies().alias("anomaly_count"),
    )
    share = (F.col("anomaly_count") / F.col(rows)).alias("anomaly_rate")
    return grouped.select(*_bounds(), *keys, *measures, rows, "anomaly_count", share)


def summarise_all(df: DataFrame, duration: str = K.WINDOW, watermark: str | None = None) -> DataFrame:
    """All streams' windows in one widened table, from one scan and one shuffle.

    A mixed row has NULL in the fields of the other streams, so grouping by
    every stream's keys at once gives each stream its own groups, and a
    streaming job keeps one state store in place of three.
    """
    plans = _plans()
    if watermark:
        df = df.withWatermark("timestamp", watermark)
    known = df.filter(F.col("stream").isin(*K.STREAMS))
    keys = {key: stream for stream, (names, _, _) in plans.items() for key in names}
    own = known.withColumns(
        {key: F.when(F.col("stream") == stream, F.col(key)) for key, stream in keys.items()}
    )
    measures = {
        name: (stream, column) for stream, (_, columns, _) in plans.items() for name, column in columns.items()
    }
    grouped = own.groupBy(F.window("timestamp", duration), "stream", *keys).agg(
        *[column.alias(name) for name, (_, column) in measures.items()],
        F.count(F.lit(1)).alias("row_count"),
        anomalies().alias("anomaly_count"),
    )
    return grouped.select(
        *_bounds(),
        "stream",
        *keys,
        *[F.when(F.col("stream") == stream, F.col(name)).alias(name) for name, (stream, _) in measures.items()],
        *[F.when(F.col("stream") == s, F.col("row_count")).alias(rows) for s, (_, _, rows) in plans.items()],
        "anomaly_count",
        (F.col("anomaly_count") / F.col("row_count")).alias("anomaly_rate"),
    )


def _summed(stream: str) -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    """Columns of a stream that are averaged, and those whose least or greatest is kept, by measure."""
    averages = {
        K.SENSOR_STREAM: {"avg_value": "value"},
        K.SOCIAL_STREAM: {"avg_engagement": "engagement_count"},
        K.MARKET_STREAM: {"avg_price": "price", "avg_price_change_pct": "price_change_percent"},
    }
    ends = {
        K.SENSOR_STREAM: {"min_value": F.min, "max_value": F.max},
        K.SOCIAL_STREAM: {"max_engagement": F.max},
        K.MARKET_STREAM: {"total_volume": F.sum},
    }
    return averages[stream], ends[stream], {K.SENSOR_STREAM: {"stddev_value": "value"}}.get(stream, {})


def partial_states(df: DataFrame, stream: str, duration: str = K.WINDOW) -> DataFrame:
    """One stream's windows as states that can be merged to longer windows without the rows.

    For each averaged column `n_`, `mean_` and `squares_`, the count, mean and sum of squared
    deviations; least, greatest and summed measures as they are; the row and flag counts.
    """
    keys, measures, rows = _plans()[stream]
    averages, ends, _ = _summed(stream)
    states = []
    for column in averages.values():
        states += [
            F.count(column).alias(f"n_{column}"),
            F.avg(column).alias(f"mean_{column}"),
            (F.var_pop(column) * F.count(column)).alias(f"squares_{column}"),
        ]
    return (
        df.groupBy(F.window("timestamp", duration), *keys)
        .agg(
            *states,
            *[measures[name].alias(name) for name in ends],
            F.count(F.lit(1)).alias(rows),
            anomalies().alias("anomaly_count"),
        )
        .select(F.col("window.start").alias("window_start"), "*")
        .drop("window")
    )


def summarise_states(states: DataFrame, stream: str, duration: str) -> DataFrame:
    """`summarise` over longer windows, from `partial_states` of windows that divide them.

    Squared deviations of parts add up, with what their means lie apart: each part's
    count times the square of its distance from the common mean. That mean comes with the
    group from a first, small aggregate, so nothing cancels out.
    """
    keys, _, rows = _plans()[stream]
    averages, ends, spreads = _summed(stream)
    placed = states.withColumn("_window", F.window("window_start", duration)).withColumns(
        {"_start": F.col("_window.start"), "_end": F.col("_window.end")}
    ).drop("_window")
    columns = list(averages.values())
    group = ["_start", "_end", *keys]
    means = placed.groupBy(*group).agg(
        *[F.try_divide(F.sum(F.col(f"mean_{c}") * F.col(f"n_{c}")), F.sum(f"n_{c}")).alias(f"_mean_{c}") for c in columns],
        *[F.sum(f"n_{c}").alias(f"_n_{c}") for c in columns],
        *[how(name).alias(name) for name, how in ends.items()],
        F.sum(rows).alias(rows),
        F.sum("anomaly_count").alias("anomaly_count"),
    )
    if spreads:
        named = means.select(*[F.col(name).alias(f"_of{name}") for name in group], *[F.col(f"_mean_{c}") for c in spreads.values()])
        same = [placed[name].eqNullSafe(F.col(f"_of{name}")) for name in group]
        apart = placed.join(named, same)
        squares = apart.groupBy(*group).agg(
            *[
                F.sum(F.col(f"squares_{c}") + F.col(f"n_{c}") * F.pow(F.col(f"mean_{c}") - F.col(f"_mean_{c}"), F.lit(2))).alias(f"_squares_{c}")
                for c in spreads.values()
            ]
        )
        squares = squares.withColumnsRenamed({name: f"_of{name}" for name in group})
        means = means.join(squares, [means[name].eqNullSafe(F.col(f"_of{name}")) for name in group])
    found = {name: F.col(f"_mean_{c}") for name, c in averages.items()}
    for name, c in spreads.items():
        found[name] = F.when(F.col(f"_n_{c}") > 1, F.sqrt(F.col(f"_squares_{c}") / (F.col(f"_n_{c}") - 1)))
    share = (F.col("anomaly_count") / F.col(rows)).alias("anomaly_rate")
    measures = [found[name].alias(name) if name in found else F.col(name) for name in _plans()[stream][1]]
    return means.select(
        F.col("_start").alias("window_start"), F.col("_end").alias("window_end"), *keys, *measures, rows, "anomaly_count", share
    )
