"""Named queries over the given tables, each with its DuckDB oracle."""

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tidewatch import constants as K
from tidewatch.functions.clock import last_time
from tidewatch.operators import alerts, cooldown, detect, enrich, lifecycle, reads, rollup, series
from tidewatch.plans import oracles as O
from tidewatch.plans import views
from tidewatch.session import shared_dir, shuffles_removed
from tidewatch.sources import archive, files, messages, snapshots, tables, versions
from tidewatch.streaming import alerting, job, sinks, state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

WEEK = 24 * 7
# A log is written once and lies beside all that the job makes of it; an eighth smaller than at the default of 3.
LOG_WRITER = {"compression": versions.COMPRESSION, "parquet.compression.codec.zstd.level": "9"}


def query(views_sql: str | None = None, body: str = "", recursive: bool = False):
    """Register a query under its function's name, with its oracle if it has one."""

    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return build(spark, sf_dir)

        QUERIES[build.__name__] = run
        if views_sql is not None:
            ORACLES[build.__name__] = O.with_views(views_sql, body, recursive)
        return build

    return register


def rounded(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    return df.withColumns({name: F.round(name, digits) for name in columns})


def wall_clock(df: DataFrame) -> DataFrame:
    """Times as wall-clock times, the type the given tables use."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, kind in df.dtypes if kind == "timestamp"})


def event_clock(spark: SparkSession, sf_dir: str):
    return last_time(views.table(spark, sf_dir, "events"), "ts")


EVENT_CLOCK = "(SELECT max(ts) FROM events)"
MARKET_CLOCK = "(SELECT max(l_shipdate) FROM lineitem)"


# --- enrichment --------------------------------------------------------------
@query(O.SENSORS, f"SELECT id, sensor_id, sensor_type, value, {O.CATEGORY} AS reading_category FROM sensors")
def sensor_category(spark, sf_dir):
    rows = enrich.enrich_source(views.sensors(spark, sf_dir), K.SENSOR_STREAM)
    return rows.select("id", "sensor_id", "sensor_type", "value", "reading_category")


@query(
    O.POSTS,
    f"""SELECT id, user_id, topic, sentiment, engagement_count, CAST(length(content) AS INTEGER) AS content_length,
               {O.ENGAGEMENT} AS engagement_level FROM posts""",
)
def social_enrich(spark, sf_dir):
    rows = enrich.enrich_source(views.posts(spark, sf_dir), K.SOCIAL_STREAM)
    return rows.select(
        "id", "user_id", "topic", "sentiment", "engagement_count", "content_length", "engagement_level"
    )


@query(
    O.MARKET,
    f"""SELECT symbol, sector, timestamp, order_id, line, price, price_change_percent, volume,
               {O.MOVEMENT} AS price_movement, {O.ACTIVITY} AS trading_activity FROM market""",
)
def market_enrich(spark, sf_dir):
    rows = enrich.enrich_source(views.market(spark, sf_dir), K.MARKET_STREAM)
    return rows.select(
        "symbol", "sector", "timestamp", "order_id", "line", "price", "price_change_percent", "volume",
        "price_movement", "trading_activity",
    )


@query(
    O.SENSORS,
    f"""SELECT id, {EVENT_CLOCK} AS processing_time,
               (epoch_us({EVENT_CLOCK}) // 1000000 - epoch_us(timestamp) // 1000000) * 1000 AS processing_delay_ms
        FROM sensors""",
)
def processing_delay(spark, sf_dir):
    rows = enrich.stamp(views.sensors(spark, sf_dir), event_clock(spark, sf_dir))
    return rows.select("id", "processing_time", "processing_delay_ms")


@query(
    O.MIXED,
    f"""SELECT * EXCLUDE (content), {EVENT_CLOCK} AS processing_time,
               (epoch_us({EVENT_CLOCK}) // 1000000 - epoch_us(timestamp) // 1000000) * 1000 AS processing_delay_ms,
               CASE WHEN stream = 'sensor-data' THEN {O.CATEGORY} END AS reading_category,
               CAST(length(content) AS INTEGER) AS content_length,
               CASE WHEN stream = 'social-data' THEN {O.ENGAGEMENT} END AS engagement_level,
               CASE WHEN stream = 'market-data' THEN {O.MOVEMENT} END AS price_movement,
               CASE WHEN stream = 'market-data' THEN {O.ACTIVITY} END AS trading_activity
        FROM mixed""",
)
def enrich_all(spark, sf_dir):
    return enrich.enrich_all(views.mixed(spark, sf_dir), event_clock(spark, sf_dir)).drop("content")


# --- window summaries ----------------------------------------------------------
def sensor_windows_sql(width: str) -> str:
    return f"""SELECT time_bucket(INTERVAL '{width}', timestamp) AS window_start,
               time_bucket(INTERVAL '{width}', timestamp) + INTERVAL '{width}' AS window_end,
               sensor_type, location, round(avg(value), 6) AS avg_value, min(value) AS min_value,
               max(value) AS max_value, round(stddev_samp(value), 6) AS stddev_value,
               count(*) AS reading_count, count(*) FILTER (is_anomaly) AS anomaly_count,
               round(count(*) FILTER (is_anomaly) / count(*), 6) AS anomaly_rate
        FROM sensors GROUP BY 1, 2, 3, 4"""


def social_windows_sql(width: str) -> str:
    return f"""SELECT time_bucket(INTERVAL '{width}', timestamp) AS window_start,
               time_bucket(INTERVAL '{width}', timestamp) + INTERVAL '{width}' AS window_end,
               topic, sentiment, round(avg(engagement_count), 6) AS avg_engagement,
               max(engagement_count) AS max_engagement, count(*) AS post_count,
               count(*) FILTER (is_anomaly) AS anomaly_count,
               round(count(*) FILTER (is_anomaly) / count(*), 6) AS anomaly_rate
        FROM posts GROUP BY 1, 2, 3, 4"""


def market_windows_sql(width: str) -> str:
    return f"""SELECT time_bucket(INTERVAL '{width}', timestamp) AS window_start,
               time_bucket(INTERVAL '{width}', timestamp) + INTERVAL '{width}' AS window_end,
               sector, round(avg(price), 6) AS avg_price,
               round(avg(price_change_percent), 6) AS avg_price_change_pct,
               CAST(sum(volume) AS BIGINT) AS total_volume, count(*) AS update_count,
               count(*) FILTER (is_anomaly) AS anomaly_count,
               round(count(*) FILTER (is_anomaly) / count(*), 6) AS anomaly_rate
        FROM market GROUP BY 1, 2, 3"""


def _sensor_windows(spark, sf_dir, width):
    rows = rollup.summarise(views.sensors(spark, sf_dir), K.SENSOR_STREAM, width)
    return rounded(rows, ["avg_value", "stddev_value", "anomaly_rate"])


def _social_windows(spark, sf_dir, width):
    rows = rollup.summarise(views.posts(spark, sf_dir), K.SOCIAL_STREAM, width)
    return rounded(rows, ["avg_engagement", "anomaly_rate"])


def _market_windows(spark, sf_dir, width):
    rows = rollup.summarise(views.market(spark, sf_dir), K.MARKET_STREAM, width)
    return rounded(rows, ["avg_price", "avg_price_change_pct", "anomaly_rate"])


@query(O.SENSORS, sensor_windows_sql("1 minute"))
def sensor_window_agg(spark, sf_dir):
    return _sensor_windows(spark, sf_dir, K.WINDOW)


@query(O.SENSORS, sensor_windows_sql("1 hour"))
def sensor_hour_agg(spark, sf_dir):
    return _sensor_windows(spark, sf_dir, "1 hour")


@query(O.SENSORS, sensor_windows_sql("1 hour"))
def sensor_hour_from_minutes(spark, sf_dir):
    """Hours from the stored states of minutes, without the readings."""
    path = f"{shared_dir(spark, 'states')}/minutes"
    readings = views.sensors(spark, sf_dir).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    tables.insert(rollup.partial_states(readings, K.SENSOR_STREAM), path, "window_start")
    hours = rollup.summarise_states(tables.read(spark, path), K.SENSOR_STREAM, "1 hour")
    return rounded(wall_clock(hours), ["avg_value", "stddev_value", "anomaly_rate"])


@query(O.POSTS, social_windows_sql("1 minute"))
def social_window_agg(spark, sf_dir):
    return _social_windows(spark, sf_dir, K.WINDOW)


@query(O.POSTS, social_windows_sql("1 day"))
def social_day_agg(spark, sf_dir):
    return _social_windows(spark, sf_dir, "1 day")


@query(O.MARKET, market_windows_sql("1 minute"))
def market_window_agg(spark, sf_dir):
    return _market_windows(spark, sf_dir, K.WINDOW)


@query(
    O.MIXED,
    f"""SELECT 'sensor-data' AS stream, * FROM ({sensor_windows_sql('1 minute')})
        UNION ALL BY NAME SELECT 'social-data' AS stream, * FROM ({social_windows_sql('1 minute')})
        UNION ALL BY NAME SELECT 'market-data' AS stream, * FROM ({market_windows_sql('1 minute')})""",
)
def window_agg_all(spark, sf_dir):
    rows = rollup.summarise_all(views.mixed(spark, sf_dir))
    return rounded(
        rows,
        ["avg_value", "stddev_value", "avg_engagement", "avg_price", "avg_price_change_pct", "anomaly_rate"],
    )


# --- detectors -------------------------------------------------------------------
def zscore_sql(key: str, source: str = "sensors", value: str = "value") -> str:
    return f"""
  SELECT *, CASE WHEN seen < 10 THEN 0.0 WHEN spread = 0 THEN 0.0
                 ELSE abs(({value} - mean) / spread) END AS score
  FROM (SELECT *, row_number() OVER series AS seen, avg({value}) OVER frame AS mean,
               stddev_pop({value}) OVER frame AS spread
        FROM {source}
        WINDOW series AS (PARTITION BY {key} ORDER BY timestamp, id),
               frame AS (PARTITION BY {key} ORDER BY timestamp, id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))"""


def moving_average_sql(key: str) -> str:
    return f"""
  SELECT *, CASE WHEN seen >= 10 THEN 3 * spread ELSE 0.2 * ma END AS bound, abs(value - ma) AS deviation
  FROM (SELECT *, stddev_pop(ma) OVER (PARTITION BY {key} ORDER BY timestamp, id
                                       ROWS BETWEEN 95 PRECEDING AND 1 PRECEDING) AS spread
        FROM (SELECT *, CASE WHEN seen >= 5 THEN mean END AS ma
              FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY timestamp, id) AS seen,
                           avg(value) OVER (PARTITION BY {key} ORDER BY timestamp, id
                                            ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS mean
                    FROM sensors)))"""


ZSCORE_COLUMNS = "id, sensor_id, location, value, round(score, 6) AS anomaly_score, score > 3 AS is_anomaly"
MA_COLUMNS = """id, sensor_id, location, value,
  CASE WHEN seen < 5 THEN 0.0 WHEN ma = 0 THEN NULL ELSE round(deviation / ma, 6) END AS anomaly_score,
  seen >= 5 AND deviation > bound AS is_anomaly"""


def _scored(df: DataFrame) -> DataFrame:
    rows = df.select("id", "sensor_id", "location", "value", "anomaly_score", "is_anomaly")
    return rounded(rows, ["anomaly_score"])


@query(O.SENSORS, f"SELECT {ZSCORE_COLUMNS} FROM ({zscore_sql('sensor_id')})")
def zscore(spark, sf_dir):
    return _scored(detect.zscore(views.sensors(spark, sf_dir), "sensor_id", "value", ["timestamp", "id"]))


@query(O.SENSORS, f"SELECT {ZSCORE_COLUMNS} FROM ({zscore_sql('location')})")
def zscore_by_place(spark, sf_dir):
    return _scored(detect.zscore(views.sensors(spark, sf_dir), "location", "value", ["timestamp", "id"]))


@query(O.SENSORS, f"SELECT {MA_COLUMNS} FROM ({moving_average_sql('sensor_id')})")
def moving_average(spark, sf_dir):
    rows = views.sensors(spark, sf_dir)
    return _scored(detect.moving_average(rows, "sensor_id", "value", ["timestamp", "id"]))


@query(O.SENSORS, f"SELECT {MA_COLUMNS} FROM ({moving_average_sql('location')})")
def moving_average_by_place(spark, sf_dir):
    rows = views.sensors(spark, sf_dir)
    return _scored(detect.moving_average(rows, "location", "value", ["timestamp", "id"]))


@query(O.SENSORS, f"SELECT {ZSCORE_COLUMNS} FROM ({zscore_sql('location')})")
def zscore_split(spark, sf_dir):
    """Each place cut into blocks of 500 rows."""
    rows = views.sensors(spark, sf_dir)
    return _scored(detect.zscore(rows, "location", "value", ["timestamp", "id"], block_rows=500))


@query(O.SENSORS, f"SELECT {MA_COLUMNS} FROM ({moving_average_sql('location')})")
def moving_average_split(spark, sf_dir):
    rows = views.sensors(spark, sf_dir)
    return _scored(detect.moving_average(rows, "location", "value", ["timestamp", "id"], block_rows=500))


DIRTY = (
    O.SENSORS
    + """,
dirty AS (
  SELECT id, timestamp, CASE sensor_type WHEN 'motion' THEN NULL WHEN 'light' THEN '' ELSE sensor_id END AS sensor_id,
         CASE WHEN value < 0 THEN 'n/a' WHEN value > 200 THEN 'NaN' ELSE CAST(value AS VARCHAR) END AS reading
  FROM sensors),
clean AS (SELECT id, timestamp, sensor_id, CAST(reading AS DOUBLE) AS value
          FROM dirty WHERE sensor_id <> '' AND reading NOT IN ('n/a', 'NaN'))
"""
)


@query(
    DIRTY,
    f"""SELECT d.id, d.sensor_id, reading, coalesce(round(score, 6), 0.0) AS anomaly_score,
               coalesce(score > 3, false) AS is_anomaly
        FROM dirty d LEFT JOIN ({zscore_sql('sensor_id', 'clean')}) s ON s.id = d.id WHERE d.sensor_id <> ''""",
)
def zscore_guards(spark, sf_dir):
    rows = views.sensors(spark, sf_dir)
    kind, value = F.col("sensor_type"), F.col("value")
    dirty = rows.select(
        "id",
        "timestamp",
        F.when(kind == "motion", None).when(kind == "light", "").otherwise(F.col("sensor_id")).alias("sensor_id"),
        F.when(value < 0, "n/a").when(value > 200, "NaN").otherwise(value.cast("string")).alias("reading"),
    )
    scored = detect.zscore(dirty, "sensor_id", "reading", ["timestamp", "id"]).drop("timestamp")
    return rounded(scored, ["anomaly_score"])


RANGES = ", ".join(f"('{n}', {low}, {high}, '{unit}')" for n, low, high, unit in K.SENSOR_RANGES)


@query(
    O.SENSORS,
    f"""SELECT id, sensor_type, s.value, CAST(lower AS DOUBLE) AS lower, CAST(upper AS DOUBLE) AS upper, r.unit,
               reading, NOT reading BETWEEN lower AND upper AS out_of_range
        FROM (SELECT *, CASE WHEN sensor_type = 'motion' THEN CAST(value > 0.5 AS DOUBLE) ELSE value END AS reading
              FROM sensors) s
        JOIN (VALUES {RANGES}) r(kind, lower, upper, unit) ON kind = sensor_type""",
)
def range_check(spark, sf_dir):
    rows = detect.range_check(views.sensors(spark, sf_dir))
    return rows.select("id", "sensor_type", "value", "lower", "upper", "unit", "reading", "out_of_range")


@query(
    O.MARKET,
    "SELECT symbol, timestamp, order_id, line, supplier, price, price_change, price_change_percent FROM market",
)
def price_change(spark, sf_dir):
    ticks = views.ticks(spark, sf_dir)
    rows = series.price_change(ticks, "symbol", "price", views.MARKET_ORDER)
    return rows.select(
        "symbol", "timestamp", "order_id", "line", "supplier", "price", "price_change", "price_change_percent"
    )


@query(
    O.MARKET,
    "SELECT symbol, timestamp, order_id, line, supplier, price, price_change, price_change_percent FROM market",
)
def price_change_split(spark, sf_dir):
    """Each symbol cut into blocks of ten ticks."""
    ticks = views.ticks(spark, sf_dir)
    rows = series.price_change(
        ticks, "symbol", "price", views.MARKET_ORDER, block_rows=10
    )
    return rows.select(
        "symbol", "timestamp", "order_id", "line", "supplier", "price", "price_change", "price_change_percent"
    )


GAPS = (
    O.TICKS
    + """,
gaps AS (
  SELECT CASE order_id % 6 WHEN 0 THEN NULL WHEN 1 THEN symbol WHEN 2 THEN symbol ELSE 'HOT' END AS symbol,
         CASE WHEN (order_id + line) % 3 <> 0 THEN timestamp END AS timestamp, order_id, line, supplier, total, price, symbol AS own
  FROM ticks)"""
)


@query(
    GAPS,
    """SELECT symbol, own, timestamp, order_id, line, supplier, price, round(coalesce(price - last, 0.0), 2) AS price_change
       FROM (SELECT *, lag(price) OVER (PARTITION BY symbol ORDER BY timestamp NULLS FIRST, order_id, line, supplier, total, own) AS last
             FROM gaps)""",
)
def price_change_gaps(spark, sf_dir):
    """Ticks of which a third have no time and a sixth no symbol, and half are of one symbol."""
    lot = F.col("order_id") % 6
    symbol = F.when(lot == 0, None).when(lot <= 2, F.col("symbol")).otherwise("HOT")
    ticks = views.ticks(spark, sf_dir).withColumn("own", F.col("symbol")).withColumn("symbol", symbol)
    ticks = ticks.withColumn("timestamp", F.when((F.col("order_id") + F.col("line")) % 3 != 0, F.col("timestamp")))
    order = ["timestamp", "order_id", "line", "supplier", "total", "own"]
    rows = series.price_change(ticks, "symbol", "price", order, block_rows=1000)
    return rows.select("symbol", "own", "timestamp", "order_id", "line", "supplier", "price", "price_change")


@query(
    O.SENSORS,
    """SELECT id, id // 11 AS series, CASE id % 11 WHEN 9 THEN value + 1000 WHEN 10 THEN value + 50000 ELSE 0.0 END AS value,
              id % 11 = 10 AND lead_count = 11 AS is_anomaly
       FROM (SELECT *, count(*) OVER (PARTITION BY id // 11) AS lead_count FROM sensors) WHERE lead_count = 11 AND id % 11 <> 9
       UNION ALL
       SELECT id, id // 11, value + 1000, false FROM (SELECT *, count(*) OVER (PARTITION BY id // 11) AS n FROM sensors)
       WHERE n = 11 AND id % 11 = 9""",
)
def zscore_at_threshold(spark, sf_dir):
    """Series of nine zeros and a tenth value, whose score is exactly 3 and no anomaly; the eleventh lies far beyond."""
    rows = views.sensors(spark, sf_dir)
    place = F.col("id") % 11
    value = F.when(place == 9, F.col("value") + 1000).when(place == 10, F.col("value") + 50000).otherwise(0.0)
    whole = Window.partitionBy("series")
    cut = rows.select("id", "timestamp", F.floor(F.col("id") / 11).alias("series"), value.alias("value"))
    cut = cut.withColumn("n", F.count("*").over(whole)).filter("n = 11")
    scored = detect.zscore(cut, "series", "value", ["timestamp", "id"])
    return scored.select("id", "series", "value", "is_anomaly")


@query(
    O.TICKS,
    """SELECT symbol, timestamp, price, volume, order_id FROM ticks
       QUALIFY row_number() OVER (PARTITION BY symbol
         ORDER BY timestamp DESC, order_id DESC, line DESC, supplier DESC, volume DESC, total DESC) = 1""",
)
def latest_per_key(spark, sf_dir):
    rows = series.latest_per_key(views.ticks(spark, sf_dir), ["symbol"], views.MARKET_ORDER)
    return rows.select("symbol", "timestamp", "price", "volume", "order_id")


# --- reads -------------------------------------------------------------------------
def _reading_columns(df):
    return df.select("id", "sensor_id", "sensor_type", "location", "timestamp", "value", "unit", "is_anomaly")


READINGS = "id, sensor_id, sensor_type, location, timestamp, value, unit, is_anomaly"


def latest_sql(columns: str, table: str, where: str = "true", hours: int = 24, limit: int = 100) -> str:
    return f"""SELECT {columns} FROM {table}
        WHERE timestamp >= {EVENT_CLOCK} - INTERVAL '{hours} hours' AND {where}
        ORDER BY timestamp DESC, id DESC LIMIT {limit}"""


@query(O.SENSORS, latest_sql(READINGS, "sensors"))
def data_recent(spark, sf_dir):
    rows = reads.latest_data(views.sensors(spark, sf_dir), event_clock(spark, sf_dir), tie=["id"])
    return _reading_columns(rows)


@query(O.SENSORS, f"SELECT count(*) AS count FROM ({latest_sql(READINGS, 'sensors')})")
def data_recent_count(spark, sf_dir):
    rows = reads.latest_data(views.sensors(spark, sf_dir), event_clock(spark, sf_dir), tie=["id"])
    return reads.counted(rows)


@query(O.SENSORS, latest_sql(READINGS, "sensors", limit=3))
def sensor_latest(spark, sf_dir):
    rows = reads.latest_data(views.sensors(spark, sf_dir), event_clock(spark, sf_dir), limit=3, tie=["id"])
    return _reading_columns(rows)


@query(O.SENSORS, latest_sql(READINGS, "sensors", "is_anomaly", WEEK))
def anomalies_recent(spark, sf_dir):
    rows = views.sensors(spark, sf_dir)
    return _reading_columns(reads.latest_anomalies(rows, event_clock(spark, sf_dir), WEEK, tie=["id"]))


@query(
    O.MIXED,
    f"""SELECT stream, source, user_id, topic, sentiment, engagement_count, timestamp FROM mixed
        WHERE is_anomaly AND source = 'social_feed_simulator'
          AND timestamp >= {EVENT_CLOCK} - INTERVAL '{WEEK} hours'
        ORDER BY timestamp DESC, user_id DESC LIMIT 100""",
)
def anomalies_by_source(spark, sf_dir):
    rows = reads.latest_anomalies(
        views.mixed(spark, sf_dir), event_clock(spark, sf_dir), WEEK, K.SOCIAL_SOURCE, tie=["user_id"]
    )
    return rows.select("stream", "source", "user_id", "topic", "sentiment", "engagement_count", "timestamp")


RECORDS = (
    O.MIXED
    + """,
records AS (
  SELECT *, 'sensor-' || id AS record FROM sensors
  UNION ALL BY NAME SELECT *, 'social-' || id AS record FROM posts
  UNION ALL BY NAME
  SELECT *, 'market-' || concat_ws('-', order_id, line, supplier, volume, CAST(floor(total * 100) AS BIGINT)) AS record
  FROM market)
"""
)


def _records(spark, sf_dir):
    """The three tables, with a text that tells all records apart."""
    cents = F.floor(F.col("total") * 100).cast("long")
    number = F.concat_ws("-", *[c.cast("string") for c in map(F.col, ["order_id", "line", "supplier", "volume"])], cents.cast("string"))
    return [
        views.sensors(spark, sf_dir).withColumn("record", F.concat(F.lit("sensor-"), F.col("id").cast("string"))),
        views.posts(spark, sf_dir).withColumn("record", F.concat(F.lit("social-"), F.col("id").cast("string"))),
        views.market(spark, sf_dir).withColumn("record", F.concat(F.lit("market-"), number)),
    ]


@query(
    RECORDS,
    f"""SELECT record, source, timestamp, sensor_id, value, user_id, engagement_count, symbol, price FROM records
        WHERE is_anomaly AND timestamp IS NOT NULL
        ORDER BY timestamp DESC, record DESC LIMIT 1000""",
)
def anomalies_all_sources(spark, sf_dir):
    rows = reads.latest_anomalies_of(
        _records(spark, sf_dir), event_clock(spark, sf_dir), None, 1000, ["record"]
    )
    return rows.select(
        "record", "source", "timestamp", "sensor_id", "value", "user_id", "engagement_count", "symbol", "price"
    )


@query(
    RECORDS,
    f"""SELECT record, strftime(timestamp, '%H:%M:%S') AS time, replace(source, '_simulator', '') AS source,
          CASE source WHEN 'sensor_simulator' THEN sensor_type || ' sensor in ' || location
            WHEN 'social_feed_simulator' THEN 'User post with ' || sentiment || ' sentiment about ' || topic
            ELSE symbol || ' (' || sector || ')' END AS details,
          CASE source
            WHEN 'sensor_simulator' THEN regexp_replace(CAST(value AS VARCHAR), '\\.0$', '') || ' ' || unit
            WHEN 'social_feed_simulator' THEN 'Engagement: ' || engagement_count
            ELSE regexp_replace(CAST(price_change_percent AS VARCHAR), '\\.0$', '') || '% ('
                 || regexp_replace(CAST(price AS VARCHAR), '\\.0$', '') || ')' END AS value
        FROM records WHERE is_anomaly AND timestamp IS NOT NULL
        ORDER BY timestamp DESC, record DESC LIMIT 1000""",
)
def anomaly_table(spark, sf_dir):
    rows = reads.latest_anomalies_of(
        _records(spark, sf_dir), event_clock(spark, sf_dir), None, 1000, ["record"]
    )
    return reads.anomaly_table(rows, ["record"])


@query(
    O.MIXED,
    f"""SELECT stream AS source, count(*) AS count, count(*) FILTER (is_anomaly) AS anomalies FROM mixed
        WHERE timestamp IS NOT NULL GROUP BY stream""",
)
def metrics_by_topic(spark, sf_dir):
    return reads.stream_metrics(views.mixed(spark, sf_dir), event_clock(spark, sf_dir), None)


@query(
    O.MIXED,
    f"""SELECT t.source, count(m.stream) AS count, count(*) FILTER (is_anomaly) AS anomalies,
               round(100 * count(*) FILTER (is_anomaly) / greatest(count(m.stream), 1), 1) AS anomaly_percent
        FROM (VALUES ('sensor_data', 'sensor-data'), ('social_data', 'social-data'), ('market_data', 'market-data'))
             t(source, name)
        LEFT JOIN (SELECT * FROM mixed WHERE timestamp >= {EVENT_CLOCK} - INTERVAL '{WEEK} hours') m
               ON m.stream = t.name GROUP BY t.source""",
)
def source_metrics(spark, sf_dir):
    return reads.source_metrics(views.mixed(spark, sf_dir), event_clock(spark, sf_dir), WEEK)


@query(
    O.MIXED,
    f"""SELECT round(avg(delay), 6) AS avg_delay, max(delay) AS max_delay, min(delay) AS min_delay
        FROM (SELECT (epoch_us({EVENT_CLOCK}) // 1000000 - epoch_us(timestamp) // 1000000) * 1000 AS delay FROM mixed
              WHERE timestamp >= {EVENT_CLOCK} - INTERVAL '{WEEK} hours') HAVING count(*) > 0""",
)
def processing_stats(spark, sf_dir):
    now = event_clock(spark, sf_dir)
    rows = enrich.stamp(views.mixed(spark, sf_dir), now)
    return rounded(reads.delay_stats(rows, event_clock(spark, sf_dir), WEEK), ["avg_delay"])


@query(
    O.SENSORS,
    f"""SELECT timestamp, strftime(timestamp, '%H:%M:%S') AS label, value AS point, is_anomaly, id
        FROM ({latest_sql('*', 'sensors', limit=10)}) WHERE sensor_type = 'temperature' ORDER BY timestamp""",
)
def temperature_series(spark, sf_dir):
    return reads.chart_series(
        views.sensors(spark, sf_dir),
        "value",
        where=F.col("sensor_type") == "temperature",
        as_of=event_clock(spark, sf_dir),
        tie=["id"],
    )


@query(
    O.MARKET,
    f"""SELECT timestamp, strftime(timestamp, '%H:%M:%S') AS label, price_change_percent AS point, is_anomaly,
               order_id, line, symbol
        FROM (SELECT * FROM market WHERE timestamp >= {MARKET_CLOCK} - INTERVAL '24 hours'
              ORDER BY timestamp DESC, order_id DESC, line DESC, symbol DESC LIMIT 10)""",
)
def market_series(spark, sf_dir):
    clock = last_time(views.table(spark, sf_dir, "lineitem"), "l_shipdate")
    rows = views.market(spark, sf_dir)
    return reads.chart_series(rows, "price_change_percent", as_of=clock, tie=["order_id", "line", "symbol"])


@query(
    O.SENSORS,
    """SELECT id, location, value, timestamp FROM sensors WHERE sensor_type = 'temperature' AND value > 20
       ORDER BY location, value DESC, id LIMIT 200""",
)
def find_many(spark, sf_dir):
    where = (F.col("sensor_type") == "temperature") & (F.col("value") > 20)
    sort = [("location", 1), ("value", -1), ("id", 1)]
    return reads.find_many(views.sensors(spark, sf_dir), where, sort, 200).select(
        "id", "location", "value", "timestamp"
    )


@query(O.SENSORS, f"SELECT {READINGS} FROM sensors WHERE is_anomaly ORDER BY timestamp, id LIMIT 1")
def find_one(spark, sf_dir):
    rows = reads.find_one(views.sensors(spark, sf_dir), F.col("is_anomaly"), ["timestamp", "id"])
    return _reading_columns(rows)


@query(
    O.SENSORS,
    """SELECT location, sensor_type, count(*) AS readings, round(sum(value), 6) AS total,
              round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high,
              count(*) FILTER (value > 100) AS above FROM sensors WHERE NOT is_anomaly GROUP BY 1, 2""",
)
def match_group(spark, sf_dir):
    rows = reads.match_group(
        views.sensors(spark, sf_dir),
        ~F.col("is_anomaly"),
        ["location", "sensor_type"],
        {
            "readings": F.count(F.lit(1)),
            "total": F.sum("value"),
            "mean": F.avg("value"),
            "low": F.min("value"),
            "high": F.max("value"),
            "above": F.count_if(F.col("value") > 100),
        },
    )
    return rounded(rows, ["total", "mean"])


# --- alerts -----------------------------------------------------------------------
SEVERE = (
    O.SENSORS
    + """,
severe AS (
  SELECT *, CASE WHEN severity > 0.9 THEN 'HIGH' WHEN severity > 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS severity_label
  FROM (SELECT *, least(1.0, value / 200) AS severity FROM sensors) WHERE severity >= 0.7)
"""
)


def _severe(spark, sf_dir):
    rows = views.sensors(spark, sf_dir).withColumn("severity", F.least(F.lit(1.0), F.col("value") / 200))
    return alerts.candidates(rows)


@query(SEVERE, "SELECT id, sensor_id, value, severity, severity_label FROM severe")
def alert_candidates(spark, sf_dir):
    return _severe(spark, sf_dir).select("id", "sensor_id", "value", "severity", "severity_label")


def iso_sql(time: str) -> str:
    return f"""CASE WHEN date_part('microsecond', {time}) % 1000000 = 0 THEN strftime({time}, '%Y-%m-%dT%H:%M:%S')
        ELSE strftime({time}, '%Y-%m-%dT%H:%M:%S.%f') END"""


def sensor_message_sql(score: str) -> str:
    return f"""'[' || severity_label || ' SEVERITY] Sensor Anomaly Detected' || chr(10)
        || 'Sensor: ' || sensor_id || ' (' || sensor_type || ')' || chr(10)
        || 'Location: ' || location || chr(10) || 'Value: ' || CAST(value AS VARCHAR) || unit || chr(10)
        || 'Anomaly Score: ' || printf('%.2f', {O.cents(score)}) || chr(10)
        || 'Timestamp: ' || {iso_sql('timestamp')}"""


SUBJECT = "'Alert: ' || source || ' Anomaly Detected'"


@query(
    SEVERE,
    f"""SELECT id, {sensor_message_sql('severity')} AS alert_text, {SUBJECT} AS subject FROM severe""",
)
def alert_message(spark, sf_dir):
    rows = _severe(spark, sf_dir).withColumn("anomaly_score", F.col("severity"))
    return alerts.with_message(rows).select("id", "alert_text", "subject")


MARKET_ALERTS = (
    O.MIXED
    + """,
scored AS (
  SELECT *, least(1.0, abs(price_change_percent) / 1000) AS severity FROM mixed
  WHERE stream = 'market-data' AND is_anomaly
  UNION ALL SELECT *, engagement_count / 1500 AS severity FROM mixed WHERE stream = 'social-data' AND is_anomaly),
severe AS (
  SELECT *, CASE WHEN severity > 0.9 THEN 'HIGH' WHEN severity > 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS severity_label
  FROM scored WHERE severity >= 0.7)
"""
)


@query(
    MARKET_ALERTS,
    f"""SELECT stream, timestamp, CASE WHEN stream = 'market-data'
          THEN '[' || severity_label || ' SEVERITY] Market Anomaly Detected' || chr(10) || 'Symbol: ' || symbol
               || chr(10) || 'Price: ' || CAST(price AS VARCHAR) || chr(10)
               || 'Price Change: ' || CAST(price_change AS VARCHAR)
          ELSE '[' || severity_label || ' SEVERITY] Social Media Anomaly Detected' || chr(10) || 'User: ' || user_id
               || chr(10) || 'Topic: ' || topic || chr(10) || 'Sentiment: ' || sentiment END
        || chr(10) || 'Anomaly Score: 0.00' || chr(10) || 'Timestamp: ' || {iso_sql('timestamp')} AS alert_text
        FROM severe""",
)
def alert_message_other(spark, sf_dir):
    """Messages of market and social anomalies, which carry no score."""
    severity = (
        F.when(F.col("stream") == K.MARKET_STREAM, F.least(F.lit(1.0), F.abs("price_change_percent") / 1000))
        .when(F.col("stream") == K.SOCIAL_STREAM, F.col("engagement_count") / 1500)
    )
    rows = reads.flagged(views.mixed(spark, sf_dir)).withColumn("severity", severity)
    return alerts.with_message(alerts.candidates(rows)).select("stream", "timestamp", "alert_text")


@query(
    SEVERE,
    f"""SELECT id, {sensor_message_sql('severity')} AS text, source, timestamp, severity, sensor_id, value
        FROM severe""",
)
def alert_payload(spark, sf_dir):
    rows = _severe(spark, sf_dir).withColumn("anomaly_score", F.col("severity"))
    fields = [c for c in rows.columns if c not in ("severity", "severity_label")]
    sent = alerts.payload(alerts.with_message(rows), fields)
    body = "text string, source string, timestamp timestamp_ntz, severity double, anomaly struct<id:long,sensor_id:string,value:double>"
    parsed = sent.select(F.from_json("payload", body).alias("p"))
    return parsed.select(
        "p.anomaly.id", "p.text", "p.source", "p.timestamp", "p.severity", "p.anomaly.sensor_id", "p.anomaly.value"
    )


REQUESTS = """requests AS (
      SELECT event_id AS id, CASE WHEN event_type <> 'error' THEN event_type || ' alert' END AS message,
             CASE WHEN value <= 200 THEN 'user-' || user_id END AS source,
             CASE WHEN event_type = 'view' THEN 'n/a' WHEN value >= 1 THEN CAST(value AS VARCHAR) END AS severity
      FROM events),
    checked AS (
      SELECT id, message, source, try_cast(severity AS DOUBLE) AS severity,
             CASE WHEN message IS NULL THEN 'Missing required field: message'
                  WHEN source IS NULL THEN 'Missing required field: source'
                  WHEN severity IS NULL THEN 'Missing required field: severity'
                  WHEN try_cast(severity AS DOUBLE) IS NULL THEN 'Severity is not a number' END AS error FROM requests)
    """


@query(
    REQUESTS,
    f"""SELECT id, message, source, severity, error, error IS NULL AS valid,
               CASE WHEN error IS NULL THEN true END AS manual,
               CASE WHEN error IS NULL THEN {EVENT_CLOCK} END AS timestamp FROM checked""",
)
def alert_validate(spark, sf_dir):
    return alerts.check_requests(_requests(spark, sf_dir), event_clock(spark, sf_dir))


def _requests(spark, sf_dir):
    """Alert requests made of events, some without a message, a source, or a
    usable severity."""
    events = views.table(spark, sf_dir, "events")
    kind, value = F.col("event_type"), F.col("value")
    return events.select(
        F.col("event_id").alias("id"),
        F.when(kind != "error", F.concat(kind, F.lit(" alert"))).alias("message"),
        F.when(value <= 200, F.concat(F.lit("user-"), F.col("user_id").cast("string"))).alias("source"),
        F.when(kind == "view", "n/a").when(value >= 1, value.cast("string")).alias("severity"),
    )


@query(
    REQUESTS,
    f"""SELECT id, source, message, severity, true AS manual, {EVENT_CLOCK} AS timestamp,
               '[' || CASE WHEN severity > 0.9 THEN 'HIGH' WHEN severity > 0.7 THEN 'MEDIUM' ELSE 'LOW' END
               || ' SEVERITY] Anomaly Detected' AS heading
        FROM checked WHERE error IS NULL AND severity >= 0.7
        QUALIFY row_number() OVER (PARTITION BY source ORDER BY id) = 1""",
)
def alert_requests(spark, sf_dir):
    """All requests are made at one time, so each source gets one through."""
    sent = alerts.requested_alerts(_requests(spark, sf_dir), ["id"], event_clock(spark, sf_dir))
    heading = F.split("alert_text", "\n")[0].alias("heading")
    return sent.select("id", "source", "message", "severity", "manual", "timestamp", heading)


def cooldown_sql(key: str, minutes: int, columns: str, source: str = "severe") -> str:
    return f""",
ranked AS (SELECT *, {key} AS alert_key, row_number() OVER (PARTITION BY {key} ORDER BY timestamp, id) AS rn
           FROM {source}),
walk AS (
  SELECT alert_key, rn, id, timestamp AS last_sent, true AS sent FROM ranked WHERE rn = 1
  UNION ALL
  SELECT r.alert_key, r.rn, r.id,
         CASE WHEN r.timestamp >= w.last_sent + INTERVAL '{minutes} minutes' THEN r.timestamp ELSE w.last_sent END,
         r.timestamp >= w.last_sent + INTERVAL '{minutes} minutes'
  FROM walk w JOIN ranked r ON r.alert_key = w.alert_key AND r.rn = w.rn + 1)
SELECT {columns} FROM ranked JOIN walk USING (alert_key, rn, id) WHERE sent"""


def _cooled(spark, sf_dir, entity, minutes):
    keyed = _severe(spark, sf_dir).withColumn("alert_key", cooldown.alert_key("source", entity))
    sent = cooldown.cooldown(keyed, "alert_key", ["timestamp", "id"], minutes)
    return sent.select("alert_key", "id", "timestamp", "severity")


@query(SEVERE.rstrip() + cooldown_sql("source || ':' || location", 15, "alert_key, id, timestamp, severity"), recursive=True)
def alert_cooldown(spark, sf_dir):
    return _cooled(spark, sf_dir, "location", K.COOLDOWN_MINUTES)


@query(SEVERE.rstrip() + cooldown_sql("source || ':' || location", 360, "alert_key, id, timestamp, severity"), recursive=True)
def alert_cooldown_6h(spark, sf_dir):
    return _cooled(spark, sf_dir, "location", 360)


@query(SEVERE.rstrip() + cooldown_sql("source", 15, "alert_key, id, timestamp, severity"), recursive=True)
def alert_cooldown_hot(spark, sf_dir):
    """All alerts under one key, which lies in as many chunks as there are."""
    keyed = _severe(spark, sf_dir).withColumn("alert_key", F.col("source"))
    sent = cooldown.cooldown(keyed, "alert_key", ["timestamp", "id"], K.COOLDOWN_MINUTES, chunk_rows=64)
    return sent.select("alert_key", "id", "timestamp", "severity")


@query(
    SEVERE.rstrip()
    + """,
timed AS (SELECT * FROM severe WHERE sensor_type <> 'light'),
untimed AS (SELECT source || ':' || location AS alert_key, id, NULL::TIMESTAMP AS timestamp, severity
            FROM severe WHERE sensor_type = 'light')"""
    + cooldown_sql("source || ':' || location", 15, "alert_key, id, timestamp, severity", source="timed")
    + " UNION ALL SELECT * FROM untimed",
    recursive=True,
)
def alert_cooldown_no_time(spark, sf_dir):
    """Alerts of light sensors come without a time: all are sent, and hold up no other."""
    severe = _severe(spark, sf_dir).withColumn("timestamp", F.when(F.col("sensor_type") != "light", F.col("timestamp")))
    keyed = severe.withColumn("alert_key", cooldown.alert_key("source", "location"))
    sent = cooldown.cooldown(keyed, "alert_key", ["timestamp", "id"], K.COOLDOWN_MINUTES)
    return sent.select("alert_key", "id", "timestamp", "severity")


END_TO_END = f"""{O.SENSORS.strip()},
scored AS ({zscore_sql('location')}),
severe AS (
  SELECT *, CASE WHEN severity > 0.9 THEN 'HIGH' WHEN severity > 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS severity_label
  FROM (SELECT *, least(1.0, score / 6.0) AS severity FROM scored WHERE score > 3) WHERE severity >= 0.7)"""


@query(
    END_TO_END
    + cooldown_sql(
        "source || ':' || location", 15,
        f"id, alert_key, timestamp, round(score, 6) AS anomaly_score, severity_label, {SUBJECT} AS subject,"
        f" {sensor_message_sql('score')} AS alert_text",
    ),
    recursive=True,
)
def alerts_end_to_end(spark, sf_dir):
    sent = alerts.score_to_alerts(views.sensors(spark, sf_dir), "location", "value", ["timestamp", "id"])
    rows = sent.select("id", "alert_key", "timestamp", "anomaly_score", "severity_label", "subject", "alert_text")
    return rounded(rows, ["anomaly_score"])


# --- messages -----------------------------------------------------------------------
ENVELOPE = (
    O.MIXED
    + """,
envelope AS (
  SELECT 'sensor-data' AS stream, sensor_id AS key, CAST(id % 4 AS INTEGER) AS partition, id AS "offset",
         timestamp + INTERVAL '2 seconds' AS ingest_time, * EXCLUDE (id) FROM sensors
  UNION ALL BY NAME
  SELECT 'social-data' AS stream, user_id AS key, CAST(id % 4 AS INTEGER) AS partition, id AS "offset",
         timestamp + INTERVAL '2 seconds' AS ingest_time, * EXCLUDE (id) FROM posts
  UNION ALL BY NAME
  SELECT 'market-data' AS stream, symbol AS key, CAST((order_id * 10 + line) % 4 AS INTEGER) AS partition,
         order_id * 10 + line AS "offset", timestamp + INTERVAL '2 seconds' AS ingest_time,
         * EXCLUDE (order_id, line, supplier, total) FROM market)
"""
)
HEAD = ["stream", "key", "partition", "offset", "ingest_time"]
HEAD_SQL = 'stream, key, partition, "offset", ingest_time'


@query(ENVELOPE, "SELECT * FROM envelope")
def decode_envelope(spark, sf_dir):
    return wall_clock(messages.decode(views.envelope(spark, sf_dir)))


@query(
    ENVELOPE,
    f"""SELECT {HEAD_SQL}, symbol, company_name, sector, price, price_change, price_change_percent, volume,
               timestamp, is_anomaly, source FROM envelope WHERE stream = 'market-data'""",
)
def decode_market(spark, sf_dir):
    return wall_clock(messages.decode_one(views.envelope(spark, sf_dir), K.MARKET_STREAM))


@query(ENVELOPE, f"SELECT {HEAD_SQL} FROM envelope WHERE stream IN ('sensor-data', 'market-data')")
def subscribe_topics(spark, sf_dir):
    rows = messages.subscribe(views.envelope(spark, sf_dir), [K.SENSOR_STREAM, K.MARKET_STREAM])
    return wall_clock(rows.select(*HEAD))


@query(
    ENVELOPE,
    f"SELECT {HEAD_SQL} FROM envelope ORDER BY stream, partition, \"offset\", key, ingest_time LIMIT 500",
)
def consume_batch(spark, sf_dir):
    batch = messages.consume_batch(views.envelope(spark, sf_dir), 500, ["key", "ingest_time"])
    return wall_clock(batch.select(*HEAD))


@query(
    ENVELOPE,
    """SELECT stream, key, count(*) AS messages, min("offset") AS first, max("offset") AS last,
              max(timestamp) AS newest FROM envelope GROUP BY stream, key""",
)
def route_by_topic(spark, sf_dir):
    """Each stream routed and read with its own schema, summed up per key."""
    envelope = views.envelope(spark, sf_dir)
    parts = [messages.decode_one(enrich.route(envelope, stream), stream) for stream in K.STREAMS]
    summed = [
        part.groupBy("stream", "key").agg(
            F.count(F.lit(1)).alias("messages"),
            F.min("offset").alias("first"),
            F.max("offset").alias("last"),
            F.max("timestamp").alias("newest"),
        )
        for part in parts
    ]
    return wall_clock(summed[0].unionByName(summed[1]).unionByName(summed[2]))


@query(
    ENVELOPE,
    f"""SELECT CASE WHEN key LIKE '%9' THEN 'other-data' ELSE stream END AS stream, key, partition, "offset",
               ingest_time, CASE WHEN key LIKE '%9' THEN 'unknown stream' WHEN key LIKE '%3' THEN 'no value'
                                 WHEN key LIKE '%5' THEN 'no time' ELSE 'malformed value' END AS error,
               CASE WHEN key NOT LIKE '%3' THEN strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') END AS text_time,
               CASE WHEN key NOT LIKE '%3' THEN key NOT LIKE '%7' END AS whole
        FROM envelope WHERE key LIKE '%9' OR key LIKE '%3' OR key LIKE '%7' OR key LIKE '%5'""",
)
def dead_letter(spark, sf_dir):
    """Messages damaged by key: unknown stream, no value, cut short, no time; of their text the time and the end."""
    key, value = F.col("key"), F.col("value")
    damaged = views.envelope(spark, sf_dir).withColumns(
        {
            "stream": F.when(key.endswith("9"), "other-data").otherwise(F.col("stream")),
            "value": F.when(key.endswith("3"), None)
            .when(key.endswith("7"), F.substring(value, F.lit(1), F.length(value) - 5))
            .when(key.endswith("5"), F.replace(value, F.lit('"timestamp"'), F.lit('"time"')))
            .otherwise(value),
        }
    )
    time = F.regexp_extract("value", '"time(?:stamp)?":"([^"]*)"', 1)
    dead = messages.dead_letters(damaged).withColumns({"text_time": time, "whole": F.endswith("value", F.lit("}"))})
    return wall_clock(dead.drop("value"))


def sensor_json_sql(extra: str = "") -> str:
    return f"""'{{"sensor_id":"' || sensor_id || '","sensor_type":"' || sensor_type || '","location":"' || location
        || '","timestamp":"' || strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') || '","value":' || CAST(value AS VARCHAR)
        || ',"unit":"' || unit || '","is_anomaly":' || CAST(is_anomaly AS VARCHAR)
        || ',"source":"' || source || '"' {extra} || '}}'"""


@query(
    O.SENSORS,
    f"""SELECT 'sensor-data' AS stream, sensor_id AS key, {sensor_json_sql()} AS value FROM sensors
        UNION ALL SELECT 'processed-data', CASE WHEN id <> 0 THEN CAST(id AS VARCHAR) END, {sensor_json_sql()}
        FROM sensors""",
)
def encode_envelope(spark, sf_dir):
    """Readings published under a text key, and again under a number key."""
    rows = views.sensors(spark, sf_dir)
    fields = [name for name in rows.columns if name != "id"]
    named = messages.encode(rows, K.SENSOR_STREAM, "sensor_id", fields)
    return named.unionByName(messages.encode(rows, K.PROCESSED_STREAM, "id", fields))


@query(
    O.SENSORS,
    f"""SELECT {sensor_json_sql("|| ',\"id\":' || id || ',\"reading_category\":\"' || category || '\"'")} AS value
        FROM (SELECT *, {O.CATEGORY} AS category FROM sensors WHERE is_anomaly)""",
)
def anomaly_feed_json(spark, sf_dir):
    rows = enrich.enrich_source(reads.flagged(views.sensors(spark, sf_dir)), K.SENSOR_STREAM)
    return messages.json_feed(rows.drop("processing_time", "processing_delay_ms"))


# --- table lifecycle ------------------------------------------------------------------
def _stored(spark, sf_dir):
    """Readings as a stored table: created when they were taken."""
    rows = views.sensors(spark, sf_dir).select("id", "sensor_id", "location", "value", "timestamp", "is_anomaly")
    return rows.withColumn("created_at", F.col("timestamp"))


STORED = (
    O.SENSORS
    + """,
stored AS (SELECT id, sensor_id, location, value, timestamp, is_anomaly, timestamp AS created_at FROM sensors)
"""
)
OLD = f"created_at < {EVENT_CLOCK} - INTERVAL '7 days'"


@query(
    O.SENSORS,
    f"SELECT id, sensor_id, CASE WHEN is_anomaly THEN timestamp ELSE {EVENT_CLOCK} END AS created_at FROM sensors",
)
def insert_defaults(spark, sf_dir):
    rows = views.sensors(spark, sf_dir)
    partly = rows.withColumn("created_at", F.when(F.col("is_anomaly"), F.col("timestamp")))
    return lifecycle.with_created(partly, event_clock(spark, sf_dir)).select("id", "sensor_id", "created_at")


STATES = f"""{O.SENSORS.strip()},
entities AS (SELECT sensor_id || '/' || sensor_type AS entity, value, location, timestamp, id FROM sensors),
old AS (SELECT entity, value, location, timestamp FROM entities
        WHERE timestamp < {EVENT_CLOCK} - INTERVAL '26 days'
        QUALIFY row_number() OVER (PARTITION BY entity ORDER BY timestamp DESC, id DESC) = 1),
new AS (SELECT entity, value, timestamp FROM entities WHERE timestamp >= {EVENT_CLOCK} - INTERVAL '4 days'
        QUALIFY row_number() OVER (PARTITION BY entity ORDER BY timestamp DESC, id DESC) = 1)"""


@query(
    STATES,
    f"""SELECT coalesce(o.entity, n.entity) AS entity,
               CASE WHEN n.entity IS NULL THEN o.value ELSE n.value END AS value, o.location,
               CASE WHEN n.entity IS NULL THEN o.timestamp ELSE n.timestamp END AS timestamp,
               CASE WHEN n.entity IS NOT NULL THEN {EVENT_CLOCK} END AS updated_at
        FROM old o FULL JOIN new n ON o.entity = n.entity""",
)
def upsert_latest(spark, sf_dir):
    """The state of the first days, brought up to date with the last ones."""
    return lifecycle.upsert(*_states(spark, sf_dir), "entity", event_clock(spark, sf_dir))


def _states(spark, sf_dir):
    """The latest reading of each entity in the first days, and in the last ones."""
    rows = views.sensors(spark, sf_dir).withColumn("entity", F.concat("sensor_id", F.lit("/"), "sensor_type"))
    clock = event_clock(spark, sf_dir)
    first = rows.filter(F.col("timestamp") < clock - F.expr("interval 26 days"))
    last = rows.filter(F.col("timestamp") >= clock - F.expr("interval 4 days"))
    order = ["timestamp", "id"]
    table = series.latest_per_key(first, ["entity"], order).select("entity", "value", "location", "timestamp")
    return table, series.latest_per_key(last, ["entity"], order).select("entity", "value", "timestamp")


@query(
    STORED,
    f"""SELECT id, location, CASE WHEN first THEN 0.0 ELSE value END AS value, timestamp,
               CASE WHEN first THEN {EVENT_CLOCK} END AS updated_at
        FROM (SELECT *, coalesce(id = (SELECT id FROM stored WHERE value > 100 AND location = 'warehouse'
                                       ORDER BY timestamp, id LIMIT 1), false) AS first FROM stored)""",
)
def update_first(spark, sf_dir):
    """The first warehouse reading above 100, set to 0."""
    rows = _stored(spark, sf_dir).select("id", "location", "value", "timestamp")
    where = (F.col("value") > 100) & (F.col("location") == "warehouse")
    return lifecycle.update_first(rows, where, {"value": F.lit(0.0)}, ["timestamp", "id"], event_clock(spark, sf_dir))


@query(STORED, "SELECT * FROM stored")
def data_by_name(spark, sf_dir):
    """A stored table, read by its name without the prefix."""
    root = shared_dir(spark, "tables")
    rows = _stored(spark, sf_dir)
    tables.insert(rows.withColumns({c: F.col(c).cast("timestamp") for c in ("timestamp", "created_at")}), f"{root}/tidewatch_processed_data")
    return wall_clock(tables.read_named(spark, root, "processed_data").select(*rows.columns))


@query(STORED, f"SELECT * FROM stored WHERE NOT ({OLD}) OR id % 7 = 3")
def archive_old_table(spark, sf_dir):
    """The table after its old rows were archived; one in seven was stored after the archive had listed them."""
    day = views.table(spark, sf_dir, "events").agg(F.max("ts")).first()[0]
    root = shared_dir(spark, "tables")
    rows = _stored(spark, sf_dir)
    moments = rows.withColumns({c: F.col(c).cast("timestamp") for c in ("timestamp", "created_at")})
    late = F.col("id") % 7 == 3
    tables.insert(moments.filter(~late), f"{root}/processed_data")
    archive.archive_old(
        spark, root, "processed_data", f"{root}/store", day,
        before_removal=lambda: tables.insert(moments.filter(late), f"{root}/processed_data"),
    )
    return wall_clock(tables.read(spark, f"{root}/processed_data").select(*rows.columns))


@query(STORED, "SELECT id, location, value, timestamp FROM stored ORDER BY timestamp DESC, id DESC LIMIT 100")
def data_newest(spark, sf_dir):
    """The newest rows of a stored table, from the newest of its files."""
    path = f"{shared_dir(spark, 'tables')}/processed_data"
    rows = _stored(spark, sf_dir)
    moments = rows.withColumns({c: F.col(c).cast("timestamp") for c in ("timestamp", "created_at")})
    tables.insert(moments.repartitionByRange(64, "timestamp"), path)
    return wall_clock(tables.read_newest(spark, path, 100, ["id"]).select("id", "location", "value", "timestamp"))


@query(
    STATES,
    f"""SELECT coalesce(o.entity, n.entity) AS entity,
               CASE WHEN n.entity IS NULL THEN o.value ELSE n.value END AS value, o.location,
               CASE WHEN n.entity IS NULL THEN o.timestamp ELSE n.timestamp END AS timestamp,
               CASE WHEN n.entity IS NOT NULL THEN {EVENT_CLOCK} END AS updated_at
        FROM old o FULL JOIN new n ON o.entity = n.entity""",
)
def upsert_files(spark, sf_dir):
    """`upsert_latest` on a stored table: files without a changed entity stay as they are."""
    path = f"{shared_dir(spark, 'tables')}/states"
    table, changes = _states(spark, sf_dir)
    moment = {"timestamp": F.col("timestamp").cast("timestamp")}
    tables.insert(table.withColumns(moment).repartitionByRange("entity"), path, keys=["entity"])
    tables.upsert_files(spark, path, changes.withColumns(moment), "entity", event_clock(spark, sf_dir).cast("timestamp"))
    return wall_clock(tables.read(spark, path).drop("created_at"))


@query(STORED, f"SELECT * FROM stored WHERE NOT ({OLD})")
def retention_table(spark, sf_dir):
    """The table after rows of more than a week were removed from its files."""
    root = shared_dir(spark, "tables")
    rows = _stored(spark, sf_dir)
    moments = rows.withColumns({c: F.col(c).cast("timestamp") for c in ("timestamp", "created_at")})
    tables.insert(moments, f"{root}/processed_data")
    day = views.table(spark, sf_dir, "events").agg(F.max("ts")).first()[0]
    tables.remove_older(spark, f"{root}/processed_data", K.ARCHIVE_DAYS, day)
    return wall_clock(tables.read(spark, f"{root}/processed_data").select(*rows.columns))


@query(STORED, "SELECT * FROM stored WHERE NOT (value > 100 AND location = 'warehouse')")
def delete_where(spark, sf_dir):
    where = (F.col("value") > 100) & (F.col("location") == "warehouse")
    return lifecycle.delete_where(_stored(spark, sf_dir), where)


@query(
    STORED,
    """SELECT * FROM stored
       WHERE id <> (SELECT id FROM stored WHERE is_anomaly ORDER BY timestamp, id LIMIT 1)""",
)
def delete_one(spark, sf_dir):
    return lifecycle.delete_one(_stored(spark, sf_dir), F.col("is_anomaly"), ["timestamp", "id"])


@query(STORED, f"SELECT * FROM stored WHERE {OLD}")
def archive_select(spark, sf_dir):
    return lifecycle.older_than(_stored(spark, sf_dir), as_of=event_clock(spark, sf_dir))


@query(
    STORED,
    f"""SELECT 'processed_data' AS collection, CAST(count(*) AS VARCHAR) AS record_count,
               strftime({EVENT_CLOCK}, '%Y%m%d%H%M%S') AS archive_date,
               {iso_sql(f"({EVENT_CLOCK} - INTERVAL '7 days')")} AS cutoff_date
        FROM stored WHERE {OLD} HAVING count(*) > 0""",
)
def archive_manifest(spark, sf_dir):
    clock = event_clock(spark, sf_dir)
    old = lifecycle.older_than(_stored(spark, sf_dir), as_of=clock)
    return lifecycle.archive_entry(old, "processed_data", as_of=clock)


@query(STORED, f"SELECT * FROM stored WHERE {OLD}")
def archive_roundtrip(spark, sf_dir):
    """Old rows written as a gzip archive and read back."""
    old = lifecycle.older_than(_stored(spark, sf_dir), as_of=event_clock(spark, sf_dir))
    path = f"{shared_dir(spark, 'archive')}/archives/processed_data/all"
    archive.write_archive(old, path)
    return archive.read_archive(spark, path, old.schema)


@query(STORED, f"SELECT * FROM stored WHERE NOT ({OLD} AND NOT is_anomaly)")
def archive_reconcile(spark, sf_dir):
    """Removal after an archive that lacks the anomalies: they stay."""
    clock = event_clock(spark, sf_dir)
    table = _stored(spark, sf_dir)
    archived = lifecycle.older_than(table, as_of=clock).filter(~F.col("is_anomaly"))
    return lifecycle.reconcile(table, archived, "id", as_of=clock)


@query(
    O.MARKET,
    f"""SELECT 'processed_data' AS name, symbol AS item, timestamp AS created_at FROM market
        WHERE timestamp >= {MARKET_CLOCK} - INTERVAL '30 days'
        UNION ALL
        SELECT DISTINCT 'aggregated_data', sector, timestamp FROM market
        WHERE timestamp >= {MARKET_CLOCK} - INTERVAL '90 days'
        UNION ALL
        SELECT 'anomalies', symbol, timestamp FROM market
        WHERE is_anomaly AND timestamp >= {MARKET_CLOCK} - INTERVAL '365 days'""",
)
def retention_keep(spark, sf_dir):
    """What the retention of each kind of table keeps."""
    clock = last_time(views.table(spark, sf_dir, "lineitem"), "l_shipdate")
    rows = views.market(spark, sf_dir).withColumn("created_at", F.col("timestamp"))
    daily = rollup.summarise(rows, K.MARKET_STREAM, "1 day").withColumn("created_at", F.col("window_start"))
    stored = {"processed_data": (rows, "symbol"), "aggregated_data": (daily, "sector"), "anomalies": (reads.flagged(rows), "symbol")}
    parts = [
        lifecycle.not_older_than(df, K.RETENTION_DAYS[name], clock).select(
            F.lit(name).alias("name"), F.col(item).alias("item"), "created_at"
        )
        for name, (df, item) in stored.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _snapshots(spark, sf_dir) -> str:
    """Three versions of the sensors' state, ten days apart; the second removed."""
    root, clock = shared_dir(spark, "snapshots"), event_clock(spark, sf_dir)
    for days in (20, 10, 0):
        known = _stored(spark, sf_dir).filter(F.col("timestamp") <= clock - F.expr(f"interval {days} days"))
        snapshots.save_snapshot(series.latest_per_key(known, ["sensor_id"], ["timestamp", "id"]), root, "sensors")
    snapshots.delete_snapshot(spark, root, "sensors", 2)
    return root


@query(
    STORED,
    f"""SELECT 'sensors_1' AS snapshot_id, 'sensors' AS name, CAST(1 AS BIGINT) AS version,
               count(DISTINCT sensor_id) AS record_count
        FROM stored WHERE timestamp <= {EVENT_CLOCK} - INTERVAL '20 days'
        UNION ALL SELECT 'sensors_3', 'sensors', 3, count(DISTINCT sensor_id) FROM stored""",
)
def snapshot_list(spark, sf_dir):
    listed = snapshots.list_snapshots(spark, _snapshots(spark, sf_dir), "sensors")
    return listed.select("snapshot_id", "name", "version", "record_count")


@query(
    STORED,
    """SELECT * FROM stored QUALIFY row_number() OVER (PARTITION BY sensor_id ORDER BY timestamp DESC, id DESC) = 1""",
)
def snapshot_latest(spark, sf_dir):
    return snapshots.load_snapshot(spark, _snapshots(spark, sf_dir), "sensors")


# --- streams ----------------------------------------------------------------------------
FILES_PER_TRIGGER = 64


def _event_stream(spark, sf_dir):
    """The events as a stream, files in order of arrival."""
    schema = views.table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_PER_TRIGGER)
    events = stream.parquet(f"{sf_dir}/events.parque[t]")
    return views.sensor_from_events(events.withColumn("ts", F.col("ts").cast("timestamp")))


def _event_batches(spark, sf_dir, late=None, parts=4, root=None):
    """The events as a stream of several micro-batches in order of time; the rows of `late` come last.

    Every task writes files of its range of time. A file stream takes files by their age,
    so each is dated after the one before. Files that `root` holds already are followed.
    """
    events = views.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    late = F.lit(False) if late is None else late
    root = f"{root or shared_dir(spark, 'events')}/events"
    found = files.data_files(spark, root)
    for place, rows in enumerate(() if found else (events.filter(~late), events.filter(late))):
        rows.repartitionByRange(4 * parts, "ts").write.option("maxRecordsPerFile", 1_000_000).parquet(f"{root}/{place}")
        found = files.data_files(spark, root)
    for age, name in enumerate(found):
        files.set_age(spark, name, age)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", max(1, len(found) // parts))
    return views.sensor_from_events(stream.parquet(f"{root}/*"))


def _run(spark, df, time="timestamp"):
    """Run a stream to the end of its input into a stored table and read that."""
    root = shared_dir(spark, "stream")
    sinks.table_sink(df, f"{root}/table", f"{root}/checkpoint", time, {"availableNow": True}).awaitTermination()
    return wall_clock(tables.read(spark, f"{root}/table").drop("created_at"))


@query(
    O.SENSORS,
    f"""SELECT * FROM ({sensor_windows_sql('1 minute')})
        WHERE window_end <= {EVENT_CLOCK} - INTERVAL '1 minute'""",
)
def stream_window_agg(spark, sf_dir):
    """One-minute summaries of the stream: the windows its watermark closed."""
    watched = _event_stream(spark, sf_dir).withWatermark("timestamp", K.WATERMARK)
    rows = _run(spark, rollup.summarise(watched, K.SENSOR_STREAM), "window_start")
    return rounded(rows, ["avg_value", "stddev_value", "anomaly_rate"])


@query(O.SENSORS, f"SELECT {ZSCORE_COLUMNS} FROM ({zscore_sql('location')})")
def stream_zscore(spark, sf_dir):
    scored = state.score_stream(_event_stream(spark, sf_dir), "location", "value", ["timestamp", "id"])
    return _scored(_run(spark, scored))


@query(
    O.SENSORS,
    f"""SELECT * FROM ({sensor_windows_sql('1 minute')})
        WHERE window_end <= {EVENT_CLOCK} - INTERVAL '1 minute'""",
)
def stream_window_agg_batches(spark, sf_dir):
    """Summaries over several micro-batches: windows that a batch begins and the next one ends."""
    watched = _event_batches(spark, sf_dir).withWatermark("timestamp", K.WATERMARK)
    rows = _run(spark, rollup.summarise(watched, K.SENSOR_STREAM), "window_start")
    return rounded(rows, ["avg_value", "stddev_value", "anomaly_rate"])


@query(
    O.SENSORS + ", on_time AS (SELECT * FROM sensors WHERE NOT (id % 50 = 0 AND timestamp < (SELECT max(ts) FROM events) - INTERVAL '20 days'))",
    f"""SELECT * FROM ({sensor_windows_sql('1 minute').replace('FROM sensors', 'FROM on_time')})
        WHERE window_end <= {EVENT_CLOCK} - INTERVAL '1 minute'""",
)
def stream_late(spark, sf_dir):
    """Rows that come days after their windows have closed change nothing."""
    clock = views.table(spark, sf_dir, "events").agg(F.max("ts")).first()[0]
    late = (F.col("event_id") % 50 == 0) & (F.col("ts") < F.lit(clock - dt.timedelta(days=20)))
    watched = _event_batches(spark, sf_dir, late).withWatermark("timestamp", K.WATERMARK)
    rows = _run(spark, rollup.summarise(watched, K.SENSOR_STREAM), "window_start")
    return rounded(rows, ["avg_value", "stddev_value", "anomaly_rate"])


@query(O.SENSORS, f"SELECT {ZSCORE_COLUMNS} FROM ({zscore_sql('location')})")
def stream_zscore_batches(spark, sf_dir):
    """Scores over several micro-batches: each goes on from the numbers that the one before kept."""
    scored = state.score_stream(_event_batches(spark, sf_dir), "location", "value", ["timestamp", "id"])
    return _scored(_run(spark, scored))


@query(
    O.TICKS,
    """SELECT symbol, timestamp, price, volume, order_id FROM ticks
       QUALIFY row_number() OVER (PARTITION BY symbol
         ORDER BY timestamp DESC, order_id DESC, line DESC, supplier DESC, volume DESC, total DESC) = 1""",
)
def stream_latest_per_key(spark, sf_dir):
    """`latest_per_key` kept up to date by a stream: each micro-batch changes the files of its keys."""
    root = shared_dir(spark, "latest")
    lines = views.table(spark, sf_dir, "lineitem")
    lines.repartition(16).write.parquet(f"{root}/lines")
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 4).parquet(f"{root}/lines")
    query = sinks.latest_sink(
        views.ticks_of(stream), f"{root}/table", "symbol", views.MARKET_ORDER, f"{root}/checkpoint", {"availableNow": True}
    )
    query.awaitTermination()
    rows = tables.read(spark, f"{root}/table")
    return wall_clock(rows.select("symbol", "timestamp", "price", "volume", "order_id"))


@query(O.SENSORS, f"SELECT {ZSCORE_COLUMNS} FROM ({zscore_sql('location')})")
def stream_restart(spark, sf_dir):
    """Scores of a stream that dies once: after its second batch is stored and before that is on record.

    Another session goes on from the checkpoint with the state as it was before that batch,
    which runs again and takes the place of what it had stored.
    """
    root = shared_dir(spark, "restart")

    def start(session, dies_after=None):
        def store(batch, batch_id):
            tables.write_batch(batch, batch_id, f"{root}/table")
            if batch_id == dies_after:
                raise ConnectionError("the job is lost")

        scored = state.score_stream(_event_batches(session, sf_dir, root=root), "location", "value", ["timestamp", "id"])
        writer = lifecycle.with_created(scored).writeStream.outputMode("append").foreachBatch(store)
        return writer.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()

    try:
        start(spark, dies_after=1).awaitTermination()
    except StreamingQueryException as lost:
        if "the job is lost" not in str(lost):
            raise
    start(spark.newSession()).awaitTermination()
    return _scored(wall_clock(tables.read(spark, f"{root}/table").drop("created_at")))


@query(O.SENSORS, f"SELECT {MA_COLUMNS} FROM ({moving_average_sql('location')})")
def stream_moving_average(spark, sf_dir):
    scored = state.score_stream(
        _event_stream(spark, sf_dir), "location", "value", ["timestamp", "id"], "moving_average"
    )
    return _scored(_run(spark, scored))


@query(SEVERE.rstrip() + cooldown_sql("source || ':' || location", 360, "alert_key, id, timestamp, severity"), recursive=True)
def stream_cooldown(spark, sf_dir):
    rows = _event_stream(spark, sf_dir).withColumn("severity", F.least(F.lit(1.0), F.col("value") / 200))
    keyed = alerts.candidates(rows).withColumn("alert_key", cooldown.alert_key("source", "location"))
    sent = _run(spark, state.cooldown_stream(keyed, "alert_key", ["timestamp", "id"], 360))
    return sent.select("alert_key", "id", "timestamp", "severity")


STREAMED_ALERTS = (
    END_TO_END
    + cooldown_sql(
        "source || ':' || location", 15,
        f"id, alert_key, timestamp, round(score, 6) AS anomaly_score, severity_label, {SUBJECT} AS subject,"
        f" {sensor_message_sql('score')} AS alert_text",
    )
)
STREAMED_COLUMNS = ["id", "alert_key", "timestamp", "anomaly_score", "severity_label", "subject", "alert_text"]


@query(STREAMED_ALERTS, recursive=True)
def stream_alerts(spark, sf_dir):
    """Scored, cooled down and written as alerts by two streaming queries."""
    root, now, order = shared_dir(spark, "alerting"), {"availableNow": True}, ["timestamp", "id"]
    rows = alerting.severe(_event_stream(spark, sf_dir), "location", "value", order)
    scoring, schema = alerting.start_scoring(rows, f"{root}/severe", f"{root}/scoring", now)
    scoring.awaitTermination()
    sent = alerting.start_alerts(
        spark, f"{root}/severe", schema, order, f"{root}/alerts", f"{root}/checkpoint", trigger=now
    )
    sent.awaitTermination()
    kept = wall_clock(tables.read(spark, f"{root}/alerts"))
    return rounded(kept.select(*STREAMED_COLUMNS), ["anomaly_score"])


@query(STREAMED_ALERTS, recursive=True)
def stream_alerts_chained(spark, sf_dir):
    """Scored, cooled down and written as alerts by one streaming query of several micro-batches."""
    root, order = shared_dir(spark, "alerting"), ["timestamp", "id"]
    sent = alerting.start_chained(
        _event_batches(spark, sf_dir), "location", "value", order, f"{root}/alerts", f"{root}/checkpoint",
        trigger={"availableNow": True},
    )
    sent.awaitTermination()
    kept = wall_clock(tables.read(spark, f"{root}/alerts"))
    return rounded(kept.select(*STREAMED_COLUMNS), ["anomaly_score"])


def write_log(spark, sf_dir, path: str) -> None:
    """The message log, stream by stream from the one with the largest shuffle; each
    shuffle's files go before the next is made and before the job runs."""
    with shuffles_removed(spark):
        for part in reversed(views.envelopes(spark, sf_dir)):
            part = part.withColumn("ingest_time", F.col("ingest_time").cast("timestamp"))
            part.write.options(**LOG_WRITER).mode("append").parquet(path)


def _job(spark, sf_dir) -> str:
    """The whole streaming job over the message log, written out as files."""
    root = shared_dir(spark, "job")
    write_log(spark, sf_dir, f"{root}/log")
    stream = messages.stream_files(spark, f"{root}/log")
    running = job.start_job(
        stream, f"{root}/tables", f"{root}/checkpoints", {"availableNow": True}
    )
    for part in running.values():
        part.awaitTermination()
    return f"{root}/tables"


@query(
    ENVELOPE,
    f"""SELECT {HEAD_SQL}, timestamp, is_anomaly, sensor_id, value, user_id, symbol, price,
               CASE WHEN stream = 'sensor-data' THEN {O.CATEGORY} END AS reading_category,
               CAST(length(content) AS INTEGER) AS content_length,
               CASE WHEN stream = 'social-data' THEN {O.ENGAGEMENT} END AS engagement_level,
               CASE WHEN stream = 'market-data' THEN {O.MOVEMENT} END AS price_movement,
               CASE WHEN stream = 'market-data' THEN {O.ACTIVITY} END AS trading_activity
        FROM envelope""",
)
def stream_job_processed(spark, sf_dir):
    """The job's table of enriched rows."""
    rows = tables.read(spark, f"{_job(spark, sf_dir)}/processed_data")
    columns = [*HEAD, "timestamp", "is_anomaly", "sensor_id", "value", "user_id", "symbol", "price"]
    derived = ["reading_category", "content_length", "engagement_level", "price_movement", "trading_activity"]
    return wall_clock(rows.select(*columns, *derived))


@query(
    O.MIXED,
    f"""SELECT * FROM (
          SELECT 'sensor-data' AS stream, * FROM ({sensor_windows_sql('1 minute')})
          UNION ALL BY NAME SELECT 'social-data' AS stream, * FROM ({social_windows_sql('1 minute')})
          UNION ALL BY NAME SELECT 'market-data' AS stream, * FROM ({market_windows_sql('1 minute')}))
        WHERE window_end <= {EVENT_CLOCK} - INTERVAL '1 minute'""",
)
def stream_job_summaries(spark, sf_dir):
    """The job's table of one-minute summaries."""
    rows = tables.read(spark, f"{_job(spark, sf_dir)}/aggregated_data")
    kept = wall_clock(rows.drop("created_at"))
    return rounded(
        kept,
        ["avg_value", "stddev_value", "avg_engagement", "avg_price", "avg_price_change_pct", "anomaly_rate"],
    )
