"""Category bounds, clocks, names and reads on hand-written rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewatch import constants as K
from tidewatch.functions import clock, ladders, text
from tidewatch.operators import enrich, reads, rollup

NOW = dt.datetime(2024, 1, 10, 12, 0, 0)


def labels(spark, values, kind, column):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [row[0] for row in df.select(column).collect()]


def test_reading_category_bounds(spark):
    values = [-0.01, 0.0, 14.99, 15.0, 24.99, 25.0, 34.99, 35.0, None]
    rows = [("temperature", v) for v in values] + [("humidity", v) for v in (29.9, 30.0, 59.9, 60.0, None)]
    rows += [("pressure", 1.0), (None, 1.0)]
    df = spark.createDataFrame(rows, "sensor_type string, value double")
    assert [row[0] for row in df.select(ladders.reading_category()).collect()] == [
        "freezing", "cold", "cold", "moderate", "moderate", "warm", "warm", "hot", "hot",
        "dry", "comfortable", "comfortable", "humid", "humid", "normal", "normal",
    ]


def test_engagement_bounds(spark):
    got = labels(spark, [9, 10, 99, 100, 999, 1000, None], "long", ladders.engagement_level("x"))
    assert got == ["low", "medium", "medium", "high", "high", "viral", "viral"]


def test_price_bounds(spark):
    values = [-5.01, -5.0, -1.01, -1.0, 0.99, 1.0, 4.99, 5.0, None]
    got = labels(spark, values, "double", ladders.price_movement("x"))
    assert got == [
        "sharp_drop", "drop", "drop", "stable", "stable", "rise", "rise", "sharp_rise", "sharp_rise",
    ]


def test_volume_bounds(spark):
    got = labels(spark, [999, 1000, 9999, 10000, None], "long", ladders.trading_activity("x"))
    assert got == ["low", "medium", "medium", "high", "high"]


def test_delay_is_in_whole_seconds(spark):
    rows = [(dt.datetime(2024, 1, 1, 0, 0, 0, 900_000), dt.datetime(2024, 1, 1, 0, 0, 2, 100_000))]
    df = spark.createDataFrame(rows, "a timestamp, b timestamp")
    row = df.select(clock.delay_ms(F.col("b"), F.col("a")), clock.delay_ms(F.col("b"), F.col("a"), True)).first()
    assert tuple(row) == (2000, 1200)


def test_enrich_all_widens_and_drops_other_streams(spark):
    schema = (
        "stream string, timestamp timestamp, sensor_type string, value double, content string,"
        " engagement_count long, price_change_percent double, volume long"
    )
    rows = [
        (K.SENSOR_STREAM, NOW, "temperature", 3.0, None, None, None, None),
        (K.SOCIAL_STREAM, NOW, None, None, "héllo", 50, None, None),
        (K.MARKET_STREAM, NOW, None, None, None, None, -2.0, 5000),
        ("other", NOW, None, None, None, None, None, None),
    ]
    out = {row["stream"]: row for row in enrich.enrich_all(spark.createDataFrame(rows, schema), NOW).collect()}
    assert set(out) == set(K.STREAMS)
    assert out[K.SENSOR_STREAM]["reading_category"] == "cold" and out[K.SENSOR_STREAM]["engagement_level"] is None
    assert out[K.SOCIAL_STREAM]["content_length"] == 5 and out[K.SOCIAL_STREAM]["engagement_level"] == "medium"
    assert out[K.SOCIAL_STREAM]["reading_category"] is None and out[K.SOCIAL_STREAM]["price_movement"] is None
    assert out[K.MARKET_STREAM]["price_movement"] == "drop" and out[K.MARKET_STREAM]["trading_activity"] == "medium"


def test_summary_counts_null_flags_as_normal(spark):
    rows = [("t", "l", NOW, 1.0, None), ("t", "l", NOW + dt.timedelta(seconds=59), 3.0, True)]
    df = spark.createDataFrame(
        rows, "sensor_type string, location string, timestamp timestamp, value double, is_anomaly boolean"
    )
    row = rollup.summarise(df, K.SENSOR_STREAM).collect()[0]
    assert (row["avg_value"], row["min_value"], row["max_value"]) == (2.0, 1.0, 3.0)
    assert (row["anomaly_count"], row["reading_count"], row["anomaly_rate"]) == (1, 2, 0.5)
    assert row["window_end"] - row["window_start"] == dt.timedelta(minutes=1)


def test_summary_of_one_reading_has_no_deviation(spark):
    df = spark.createDataFrame(
        [("t", "l", NOW, 1.0, True)],
        "sensor_type string, location string, timestamp timestamp, value double, is_anomaly boolean",
    )
    assert rollup.summarise(df, K.SENSOR_STREAM).collect()[0]["stddev_value"] is None


@pytest.fixture(scope="module")
def readings(spark):
    rows = [(i, NOW - dt.timedelta(hours=i), i % 3 == 0, K.SENSOR_STREAM, K.SENSOR_SOURCE, float(i)) for i in range(48)]
    return spark.createDataFrame(
        rows, "id long, timestamp timestamp, is_anomaly boolean, stream string, source string, value double"
    )


def ids(df):
    return [row["id"] for row in df.collect()]


def test_recent_includes_the_bound(readings):
    assert sorted(ids(reads.recent(readings, NOW, 24))) == list(range(25))


def test_limits(readings):
    assert ids(reads.latest_data(readings, NOW, limit=3, tie=["id"])) == [0, 1, 2]
    assert ids(reads.latest_data(readings, NOW, limit=0)) == []
    assert len(ids(reads.latest_data(readings, NOW, limit=None))) == 25
    assert reads.counted(reads.latest_data(readings, NOW, limit=7)).collect()[0]["count"] == 7


def test_anomalies_and_source(readings):
    assert ids(reads.latest_anomalies(readings, NOW, limit=2)) == [0, 3]
    assert ids(reads.latest_anomalies(readings, NOW, source="social_feed_simulator")) == []


def test_several_tables_are_cut_resorted_and_cut_again(readings):
    later = readings.withColumns(
        {"id": F.col("id") + 100, "timestamp": F.col("timestamp") + F.expr("interval 30 minutes")}
    )
    out = reads.latest_anomalies_of([readings, later], NOW, limit=3, tie=["id"])
    assert ids(out) == [100, 0, 103]


def test_source_metrics_name_every_source(readings):
    out = {row["source"]: tuple(row)[1:] for row in reads.source_metrics(readings, NOW).collect()}
    assert out == {"sensor_data": (25, 9, 36.0), "social_data": (0, 0, 0.0), "market_data": (0, 0, 0.0)}


def test_stats_of_nothing_have_no_row(readings):
    old = readings.withColumn("processing_delay_ms", F.lit(5)).filter("false")
    assert reads.delay_stats(old, NOW).count() == 0
    assert reads.match_group(readings, F.lit(False), [], {"n": F.sum("value")}).count() == 0


def test_chart_takes_the_newest_before_the_filter(readings):
    out = reads.chart_series(readings, "value", 10, F.col("is_anomaly"), NOW, ["id"])
    assert ids(out) == [9, 6, 3, 0]
    assert out.collect()[-1]["label"] == "12:00:00"


def test_find_many_sorts_by_several_columns(readings):
    out = reads.find_many(readings, F.col("id") < 4, [("is_anomaly", -1), ("id", 1)], 3)
    assert ids(out) == [0, 3, 1]
    assert ids(reads.find_one(readings, F.col("id") > 7, ["id"])) == [8]


def test_recent_reads_of_a_stored_table_skip_files(spark, readings, tmp_path):
    from tidewatch.sources import tables

    tables.insert(readings.repartitionByRange(4, "timestamp"), str(tmp_path / "t"), as_of=NOW)
    since = NOW - dt.timedelta(hours=5)
    rows = reads.recent(tables.read_since(spark, str(tmp_path / "t"), since), NOW, 5)
    assert sorted(ids(rows)) == [0, 1, 2, 3, 4, 5]
    assert len(rows.inputFiles()) < len(tables.listed(spark, str(tmp_path / "t")))


def test_anomaly_table_cells(spark):
    schema = (
        "timestamp timestamp, source string, sensor_type string, location string, value double, unit string,"
        " sentiment string, topic string, engagement_count long, symbol string, sector string,"
        " price_change_percent double, price double"
    )
    blank = [None] * 8
    rows = [
        (NOW, "sensor_simulator", "light", "outdoor", 10.0, "lux", *blank[:7]),
        (NOW, "social_feed_simulator", *blank[:4], "negative", "tech", 7, *blank[:4]),
        (NOW, "market_data_simulator", *blank[:7], "ABC", "Energy", -7.25, 100.0),
        (NOW, "other_simulator", *blank, *blank[:3]),
    ]
    out = [tuple(row) for row in reads.anomaly_table(spark.createDataFrame(rows, schema)).collect()]
    assert out == [
        ("12:00:00", "sensor", "light sensor in outdoor", "10 lux"),
        ("12:00:00", "social_feed", "User post with negative sentiment about tech", "Engagement: 7"),
        ("12:00:00", "market_data", "ABC (Energy)", "-7.25% (100)"),
        ("12:00:00", "other", "", ""),
    ]


def test_names():
    assert text.stored_name("x") == "tidewatch_x" and text.stored_name("tidewatch_x") == "tidewatch_x"
    assert text.restore_target("archives/processed_data/2024.json.gz") == "tidewatch_processed_data"
    assert text.restore_target("/some/root/archives/anomalies/2024", prefix="") == "anomalies"
    with pytest.raises(ValueError):
        text.restore_target("archives/2024")
