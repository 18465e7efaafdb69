"""Recency, top-N and metrics reads over stored tables."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import constants as K
from tidewatch.functions import text
from tidewatch.functions.clock import before, clock_label
from tidewatch.operators.rollup import anomalies


def recent(df: DataFrame, as_of=None, hours: float | None = K.RECENT_HOURS) -> DataFrame:
    """Rows of the last hours, of all time for None; rows without a time are in
    neither."""
    if hours is None:
        return df.filter(F.col("timestamp").isNotNull())
    since = before(as_of, hours=hours)
    return df.filter(F.col("timestamp") >= since)


def newest(df: DataFrame, limit: int | None, tie: Sequence[str] = ()) -> DataFrame:
    """Newest rows first; `limit` None means all, 0 none. `tie` orders rows of
    the same time, newest id first."""
    ordered = df.orderBy(F.desc("timestamp"), *[F.desc(name) for name in tie])
    return ordered if limit is None else ordered.limit(limit)


def latest_data(df, as_of=None, hours=K.RECENT_HOURS, limit=K.READ_LIMIT, tie=()) -> DataFrame:
    return newest(recent(df, as_of, hours), limit, tie)


def counted(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("count"))


def flagged(df: DataFrame) -> DataFrame:
    return df.filter("is_anomaly = true")


def latest_anomalies(
    df, as_of=None, hours=K.RECENT_HOURS, source: str | None = None, limit=K.READ_LIMIT, tie=()
) -> DataFrame:
    rows = flagged(df)
    if source:
        rows = rows.filter(F.col("source") == source)
    return latest_data(rows, as_of, hours, limit, tie)


def latest_anomalies_of(
    tables: Sequence[DataFrame], as_of=None, hours=K.RECENT_HOURS, limit=K.READ_LIMIT, tie=()
) -> DataFrame:
    """Newest anomalies over several tables. Each is cut to the limit first:
    a sorted limit does not move below a union by itself."""
    parts = [latest_anomalies(table, as_of, hours, None, limit, tie) for table in tables]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    return newest(merged, limit, tie)


def stream_metrics(df: DataFrame, as_of=None, hours=K.RECENT_HOURS, by: str = "stream") -> DataFrame:
    """Rows and anomalies of the last hours by stream."""
    return (
        recent(df, as_of, hours)
        .groupBy(F.col(by).alias("source"))
        .agg(F.count(F.lit(1)).alias("count"), anomalies().alias("anomalies"))
    )


def delay_stats(df: DataFrame, as_of=None, hours=K.RECENT_HOURS) -> DataFrame:
    """Delay statistics of the last hours; no row when there is no data."""
    delay = F.col("processing_delay_ms")
    return (
        recent(df, as_of, hours)
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            F.avg(delay).alias("avg_delay"),
            F.max(delay).alias("max_delay"),
            F.min(delay).alias("min_delay"),
        )
        .filter(F.col("_rows") > 0)
        .drop("_rows")
    )


def source_metrics(df: DataFrame, as_of=None, hours=K.RECENT_HOURS, by: str = "stream") -> DataFrame:
    """Rows, anomalies and their rate per known source, zeros included."""
    known = df.sparkSession.createDataFrame(
        list(K.SOURCE_TABLES.items()), "source string, _stream string"
    )
    counts = stream_metrics(df, as_of, hours, by).withColumnRenamed("source", "_found")
    joined = known.join(counts, F.col("_stream") == F.col("_found"), "left")
    rows = F.coalesce(F.col("count"), F.lit(0))
    bad = F.coalesce(F.col("anomalies"), F.lit(0))
    return joined.select(
        "source",
        rows.alias("count"),
        bad.alias("anomalies"),
        F.round(100 * bad / F.greatest(rows, F.lit(1)), 1).alias("anomaly_percent"),
    )


def chart_series(
    df: DataFrame, value: str, limit: int = 10, where: Column | None = None, as_of=None, tie=()
) -> DataFrame:
    """Chart points: the newest rows, then the filter, then oldest first."""
    rows = latest_data(df, as_of, limit=limit, tie=tie)
    if where is not None:
        rows = rows.filter(where)
    return rows.orderBy("timestamp", *tie).select(
        "timestamp",
        clock_label(F.col("timestamp")).alias("label"),
        F.col(value).alias("point"),
        "is_anomaly",
        *tie,
    )


def anomaly_table(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Display columns of anomalies: time of day, source, details, value."""
    details, value = text.table_cells()
    return df.select(
        *keep,
        clock_label(F.col("timestamp")).alias("time"),
        text.short_source().alias("source"),
        details.alias("details"),
        value.alias("value"),
    )


def find_many(
    df: DataFrame,
    where: Column | None = None,
    sort: Sequence[tuple[str, int]] = (),
    limit: int | None = None,
) -> DataFrame:
    """Filter, then sort by (column, 1 or -1) pairs, then limit."""
    rows = df if where is None else df.filter(where)
    if sort:
        rows = rows.orderBy(*[F.asc(name) if way > 0 else F.desc(name) for name, way in sort])
    return rows if limit is None else rows.limit(limit)


def find_one(df: DataFrame, where: Column | None, order: Sequence[str]) -> DataFrame:
    return find_many(df, where, [(name, 1) for name in order], 1)


def match_group(
    df: DataFrame, match: Column | None, keys: Sequence[str], measures: dict[str, Column]
) -> DataFrame:
    """Filter, group and aggregate; without keys one row, and none for no data."""
    rows = df if match is None else df.filter(match)
    columns = [column.alias(name) for name, column in measures.items()]
    if keys:
        return rows.groupBy(*keys).agg(*columns)
    grouped = rows.agg(F.count(F.lit(1)).alias("_rows"), *columns)
    return grouped.filter(F.col("_rows") > 0).drop("_rows")
