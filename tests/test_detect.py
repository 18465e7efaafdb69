"""Detectors and series against the sequential rules, with and without split keys."""

import datetime as dt

import numpy as np
import pytest
import sequential
from pyspark.sql import functions as F

from tidewatch.operators import detect, series
from tidewatch.streaming import state

START = dt.datetime(2024, 1, 1)


def make(spark, per_key, step=20):
    """Rows of (key, ts, id, value); ids and times rise together in a key."""
    rows, number = [], 0
    for key, values in per_key.items():
        for i, value in enumerate(values):
            rows.append((key, START + dt.timedelta(seconds=step * i), number, value))
            number += 1
    return spark.createDataFrame(rows, "key string, ts timestamp, id long, value double").repartition(5)


def scored(df):
    rows = {}
    for row in df.orderBy("key", "id").collect():
        rows.setdefault(row["key"], []).append((row["anomaly_score"], row["is_anomaly"]))
    return rows


def same(have, want):
    assert have.keys() == want.keys()
    for key in want:
        assert len(have[key]) == len(want[key])
        for i, ((score, flag), (right_score, right_flag)) in enumerate(zip(have[key], want[key])):
            # ten values reach a z-score of 3 at most, up to the last digit
            if right_score is None or abs(right_score - 3) > 1e-9:
                assert flag == right_flag, (key, i)
            if right_score is None:
                assert score is None, (key, i)
            else:
                assert score == pytest.approx(right_score, rel=1e-9, abs=1e-9), (key, i)


def example():
    random = np.random.default_rng(7)
    hot = random.normal(50, 10, 900)
    hot[::97] += 200
    hot[300:450] = 41.5
    return {
        "hot": hot.tolist(),
        "walk": np.cumsum(random.normal(0, 1, 350)).tolist(),
        "constant": [0.1] * 130,
        "huge": [1e9 if i == 40 else float(i % 7) for i in range(260)],
        "nine": [1.0] * 8 + [100.0],
        "ten": [1.0] * 9 + [100.0],
        "eleven": [1.0] * 10 + [100.0],
        "negative": (-20 + random.normal(0, 1, 30)).tolist(),
        "zero_mean": [1.0, -1.0, 2.0, -2.0, 0.0, 3.0, -3.0, 0.0, 0.0, 0.0, 5.0, 1.0],
        "dirty": [None if i % 9 == 4 else float("nan") if i % 11 == 3 else float(i % 5) for i in range(140)],
        "one": [3.0],
    }


@pytest.mark.parametrize("block_rows", [1_000_000, 1, 100, 130, 257])
def test_zscore(spark, block_rows):
    data = example()
    rows = detect.zscore(make(spark, data), "key", "value", ["ts", "id"], block_rows=block_rows)
    same(scored(rows), {key: sequential.zscore(values) for key, values in data.items()})


@pytest.mark.parametrize("block_rows", [1_000_000, 1, 100, 130, 257])
def test_moving_average(spark, block_rows):
    data = example()
    rows = detect.moving_average(make(spark, data), "key", "value", ["ts", "id"], block_rows=block_rows)
    same(scored(rows), {key: sequential.moving_average(values) for key, values in data.items()})


@pytest.mark.parametrize("window_size", [5, 12, 30])
@pytest.mark.parametrize("block_rows", [1_000_000, 40])
def test_other_window_sizes(spark, window_size, block_rows):
    data = {key: values for key, values in example().items() if key in ("hot", "walk", "dirty", "zero_mean")}
    df = make(spark, data)
    rows = detect.zscore(df, "key", "value", ["ts", "id"], window_size, block_rows=block_rows)
    same(scored(rows), {key: sequential.zscore(values, window_size) for key, values in data.items()})
    rows = detect.moving_average(
        df, "key", "value", ["ts", "id"], ma_window=4, window_size=window_size, block_rows=block_rows
    )
    want = {key: sequential.moving_average(values, 4, window_size) for key, values in data.items()}
    same(scored(rows), want)


def test_split_key_with_equal_times(spark):
    """All rows of a long key at one time: the id orders and cuts them."""
    values = np.random.default_rng(3).normal(0, 1, 500).tolist()
    df = make(spark, {"k": values, "small": values[:30]}, step=0)
    rows = detect.zscore(df, "key", "value", ["ts", "id"], block_rows=120)
    same(scored(rows), {"k": sequential.zscore(values), "small": sequential.zscore(values[:30])})


def test_split_keeps_every_row_once_and_bounds_blocks(spark):
    df = make(spark, {"hot": [float(i) for i in range(1000)], "small": [1.0] * 50})
    blocks = series.in_blocks(df, ["key"], ["ts", "id"], 9, block_rows=100)
    kept = blocks.filter(~F.col(series.CARRIED))
    assert kept.count() == 1050 and kept.select("id").distinct().count() == 1050
    sizes = [row["n"] for row in blocks.groupBy("key", series.BLOCK).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) <= 109


def test_eleventh_value_is_the_first_that_can_be_flagged(spark):
    data = {"ten": [1.0] * 9 + [100.0], "eleven": [1.0] * 10 + [100.0]}
    flags = scored(detect.zscore(make(spark, data), "key", "value", ["ts", "id"]))
    assert not any(flag for _, flag in flags["ten"])
    assert flags["eleven"][-1][1]


def test_rows_without_a_key_are_dropped(spark):
    rows = [(None, START, 1, "1"), ("", START, 2, "2"), ("a", START, 3, "x"), ("a", START, 4, "NaN")]
    df = spark.createDataFrame(rows, "key string, ts timestamp, id long, value string")
    out = detect.zscore(df, "key", "value", ["ts", "id"]).orderBy("id").collect()
    assert [(row["id"], row["anomaly_score"], row["is_anomaly"]) for row in out] == [
        (3, 0.0, False),
        (4, 0.0, False),
    ]


def test_zero_is_a_key(spark):
    df = spark.createDataFrame([(0, START, 1, 2.0)], "key long, ts timestamp, id long, value double")
    assert detect.zscore(df, "key", "value", ["ts", "id"]).count() == 1


@pytest.mark.parametrize("block_rows", [1_000_000, 7])
def test_price_change(spark, block_rows):
    prices = [10.0, 11.0, 11.0, 5.5, 0.0, 3.0] * 6
    df = make(spark, {"a": prices, "b": [4.0]}).withColumnRenamed("value", "price")
    out = series.price_change(df, "key", "price", ["ts", "id"], block_rows=block_rows).orderBy("key", "id").collect()
    assert len(out) == len(prices) + 1
    for i, row in enumerate(out[:-1]):
        last = prices[i - 1] if i else None
        move = 0.0 if last is None else round(prices[i] - last, 2)
        percent = 0.0 if not last else round(100 * (prices[i] - last) / last, 2)
        assert (row["price_change"], row["price_change_percent"]) == (move, percent), i
    assert (out[-1]["price_change"], out[-1]["price_change_percent"]) == (0.0, 0.0)


def test_latest_per_key_takes_ties_by_id(spark):
    rows = [("a", START, 1, 1.0), ("a", START, 2, 2.0), ("b", START, 3, 3.0)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, id long, value double")
    out = series.latest_per_key(df, ["key"], ["ts", "id"]).orderBy("key").collect()
    assert [(row["key"], row["id"]) for row in out] == [("a", 2), ("b", 3)]


def test_range_check_flags_outside_and_bounds_belong_inside(spark):
    rows = [("temperature", 15.0), ("temperature", 30.0), ("temperature", 14.99), ("humidity", 70.01),
            ("motion", 0.6), ("light", 0.0), ("other", 1.0)]
    df = spark.createDataFrame(rows, "sensor_type string, value double")
    out = {(row["sensor_type"], row["value"]): row for row in detect.range_check(df).collect()}
    assert not out["temperature", 15.0]["out_of_range"] and not out["temperature", 30.0]["out_of_range"]
    assert out["temperature", 14.99]["out_of_range"] and out["humidity", 70.01]["out_of_range"]
    assert out["motion", 0.6]["reading"] == 1.0 and not out["light", 0.0]["out_of_range"]
    assert out["other", 1.0]["out_of_range"] is None


def test_a_score_at_the_threshold_is_no_anomaly(spark):
    """Nine equal values and another: the score is 3, whatever rounding makes of it, on tables and streams."""
    draw = np.random.default_rng(9)
    data = {f"k{i}": [float(a)] * 9 + [float(b)] for i, (a, b) in enumerate(draw.normal(0, 50, (100, 2)))}
    flags = scored(detect.zscore(make(spark, data), "key", "value", ["ts", "id"]))
    assert not any(flag for rows in flags.values() for _, flag in rows)
    assert not any(state.zscores(np.array(values), 100, 3.0)[1].any() for values in data.values())


def test_scores_are_equal_to_the_last_bit_however_rows_are_spread(spark):
    df = make(spark, {"k": draw_values(700), "l": draw_values(90)})
    whole = scored(detect.zscore(df, "key", "value", ["ts", "id"]))
    for rows in (df.repartition(3), df.coalesce(1), df.repartition(13)):
        for block_rows in (1_000_000, 100, 300):
            assert scored(detect.zscore(rows, "key", "value", ["ts", "id"], block_rows=block_rows)) == whole


def draw_values(n):
    return np.random.default_rng(n).normal(10, 3, n).tolist()


def test_rows_without_a_time_or_key_keep_their_change(spark):
    rows = [(None if i % 3 == 0 else "a", None if i % 2 else START, i, float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, id long, price double")
    out = series.price_change(df, "key", "price", ["ts", "id"], block_rows=10)
    assert sorted(row["id"] for row in out.collect()) == list(range(40))
