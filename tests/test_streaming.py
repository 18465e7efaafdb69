"""The streaming job on files written one by one in time order."""

import datetime as dt
import json
import time

import numpy as np
import pandas as pd
import pytest
import sequential
from pyspark.sql import functions as F

from tidewatch import constants as K
from tidewatch import schemas
from tidewatch.operators import alerts, cooldown, detect, rollup
from tidewatch.plans import views
from tidewatch.sources import messages, tables
from tidewatch.streaming import alerting, chained, job, sinks, state

NOW = {"availableNow": True}
START = dt.datetime(2024, 1, 1)


def write_in_order(frames, path):
    """One file per frame; file times must rise, as the source orders by them."""
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)


@pytest.fixture(scope="module")
def log(spark, sf_dir, tmp_path_factory):
    """The sensor and social messages of the smallest tables, in four files."""
    root = tmp_path_factory.mktemp("log")
    envelope = views.envelope(spark, sf_dir).filter(F.col("stream") != K.MARKET_STREAM)
    envelope = envelope.withColumn("ingest_time", F.col("ingest_time").cast("timestamp"))
    day = F.floor((F.dayofmonth("ingest_time") - 1) / 8)
    write_in_order([envelope.filter(day == i) for i in range(4)], f"{root}/log")
    return f"{root}/log"


def finish(queries):
    for query in queries.values():
        query.awaitTermination()


def job_tables(spark, root):
    kept = {}
    for name in ("processed_data", "anomalies", "aggregated_data"):
        rows = tables.read(spark, f"{root}/{name}").drop("created_at", "processing_time", "processing_delay_ms")
        kept[name] = sorted(map(str, rows.collect()))
    return kept


def test_job_equals_batch(spark, log, tmp_path):
    queries = job.start_job(messages.stream_files(spark, log, 1), f"{tmp_path}/t", f"{tmp_path}/c", NOW)
    finish(queries)
    batch = messages.decode(spark.read.parquet(log))
    last = batch.agg(F.max("timestamp")).first()[0]
    closed = rollup.summarise_all(batch).filter(F.col("window_end") <= F.lit(last - dt.timedelta(minutes=1)))
    assert job.dropped_late_rows(queries["aggregated"]) == 0
    streamed = tables.read(spark, f"{tmp_path}/t/aggregated_data").select(*closed.columns)
    assert sorted(map(str, streamed.collect())) == sorted(map(str, closed.collect()))

    processed = tables.read(spark, f"{tmp_path}/t/processed_data")
    assert processed.count() == batch.count() and processed.filter("created_at is null").count() == 0
    flagged = batch.filter("is_anomaly").count()
    assert tables.read(spark, f"{tmp_path}/t/anomalies").count() == flagged
    feed = [json.loads(row["value"]) for row in spark.read.text(f"{tmp_path}/t/{K.ANOMALY_STREAM}").collect()]
    assert len(feed) == flagged and all(message["is_anomaly"] for message in feed)


def test_restart_continues_from_the_checkpoint(spark, log, tmp_path):
    whole = job.start_job(messages.stream_files(spark, log, 1), f"{tmp_path}/t1", f"{tmp_path}/c1", NOW)
    finish(whole)
    # the same files arrive in two parts, with a stop in between
    files = sorted(spark.read.parquet(log).inputFiles(), key=lambda f: spark.read.parquet(f).agg(F.min("ingest_time")).first()[0])
    for part in (files[:2], files[2:]):
        write_in_order([spark.read.parquet(file) for file in part], f"{tmp_path}/log")
        finish(job.start_job(messages.stream_files(spark, f"{tmp_path}/log", 1), f"{tmp_path}/t2", f"{tmp_path}/c2", NOW))
    assert job_tables(spark, f"{tmp_path}/t1") == job_tables(spark, f"{tmp_path}/t2")


def sensor_message(at, value=1.0, key="s1"):
    value = json.dumps(
        {"sensor_id": key, "sensor_type": "light", "location": "outdoor", "timestamp": at.isoformat(),
         "value": value, "unit": "lux", "is_anomaly": value > 100, "source": "sensor_simulator"}
    )
    return (key, value, K.SENSOR_STREAM, 0, 0, at)


def test_late_rows_are_dropped_and_closed_windows_stay(spark, tmp_path):
    # a batch drops rows by the watermark the batch before it used
    minutes = [[0, 1, 2], [10, 11], [20], [1, 21], [40]]
    frames = [
        spark.createDataFrame([sensor_message(START + dt.timedelta(minutes=m)) for m in part], schemas.ENVELOPE)
        for part in minutes
    ]
    write_in_order(frames, f"{tmp_path}/log")
    queries = job.start_job(
        messages.stream_files(spark, f"{tmp_path}/log", 1), f"{tmp_path}/t", f"{tmp_path}/c", NOW
    )
    finish(queries)
    assert job.dropped_late_rows(queries["aggregated"]) == 1
    rows = tables.read(spark, f"{tmp_path}/t/aggregated_data").orderBy("window_start").collect()
    assert [(row["window_start"].minute, row["reading_count"]) for row in rows] == [
        (0, 1), (1, 1), (2, 1), (10, 1), (11, 1), (20, 1), (21, 1),
    ]
    assert tables.read(spark, f"{tmp_path}/t/processed_data").count() == 9


@pytest.mark.parametrize("backfill", [False, True])
def test_job_keeps_no_copy_of_a_batch_beside_its_tables(spark, tmp_path, monkeypatch, backfill):
    """Batches of good and bad messages, of bad ones only and of good ones only; nothing stays persisted while they are written."""
    values = [[1.0, 200.0, None], [None, None], [300.0]]
    frames = [
        [
            ("k", "{broken", K.SENSOR_STREAM, i, j, START) if v is None else sensor_message(START + dt.timedelta(minutes=i), v)
            for j, v in enumerate(part)
        ]
        for i, part in enumerate(values)
    ]
    write_in_order([spark.createDataFrame(rows, schemas.ENVELOPE) for rows in frames], f"{tmp_path}/log")
    before, kept, real = set(spark.sparkContext._jsc.getPersistentRDDs()), [], tables.write_batch

    def watching(df, batch_id, path, *rest, **options):
        if "aggregated" not in path:
            kept.append(set(spark.sparkContext._jsc.getPersistentRDDs()) - before)
        return real(df, batch_id, path, *rest, **options)

    monkeypatch.setattr(tables, "write_batch", watching)
    stream = messages.stream_files(spark, f"{tmp_path}/log", 1)
    finish({"events": job.start_job(stream, f"{tmp_path}/t", f"{tmp_path}/c", NOW, backfill=backfill)["events"]})
    assert len(kept) == 9 and (backfill or not any(kept))
    stored = {name: tables.read(spark, f"{tmp_path}/t/{name}") for name in ("processed_data", "anomalies", K.ERROR_STREAM)}
    assert sorted(row["value"] for row in stored["processed_data"].collect()) == [1.0, 200.0, 300.0]
    flagged = stored["anomalies"].collect()
    assert sorted(row["value"] for row in flagged) == [200.0, 300.0]
    assert set(flagged) <= set(stored["processed_data"].collect())
    bad = stored[K.ERROR_STREAM].collect()
    assert sorted((row["partition"], row["offset"]) for row in bad) == [(0, 2), (1, 0), (1, 1)]
    assert {(row["value"], row["error"]) for row in bad} == {("{broken", "malformed value")}
    feed = [json.loads(row["value"]) for row in spark.read.text(f"{tmp_path}/t/{K.ANOMALY_STREAM}").collect()]
    assert sorted(message["value"] for message in feed) == [200.0, 300.0] and "created_at" not in feed[0]


def test_a_job_without_bad_messages_has_an_empty_table_of_them(spark, tmp_path):
    write_in_order([spark.createDataFrame([sensor_message(START)], schemas.ENVELOPE)], f"{tmp_path}/log")
    finish(job.start_job(messages.stream_files(spark, f"{tmp_path}/log"), f"{tmp_path}/t", f"{tmp_path}/c", NOW))
    bad = tables.read(spark, f"{tmp_path}/t/{K.ERROR_STREAM}")
    assert bad.count() == 0 and {*messages.HEAD, "value", "error", "created_at"} == set(bad.columns)


def test_the_shuffles_of_the_log_are_gone_when_the_job_starts(spark, sf_dir, monkeypatch):
    from tidewatch.plans import registry
    from tidewatch.session import CLEANUP

    def shuffles():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        names = [found.apply(i).getName() for i in range(found.size())]
        return {name for name in names if name.startswith("shuffle_")}

    class Started(Exception):
        pass

    before, setting, left = shuffles(), spark.conf.get(CLEANUP, None), []

    def start(*_):
        until = time.time() + 10
        while (new := shuffles() - before) and time.time() < until:
            time.sleep(0.2)
        left.append(new)
        raise Started

    monkeypatch.setattr(job, "start_job", start)
    with pytest.raises(Started):
        registry._job(spark, sf_dir)
    assert left == [set()] and spark.conf.get(CLEANUP, None) == setting


def test_the_log_holds_every_message_once(spark, sf_dir, tmp_path):
    from tidewatch.plans import registry

    registry.write_log(spark, sf_dir, f"{tmp_path}/log")
    whole = views.envelope(spark, sf_dir).withColumn("ingest_time", F.col("ingest_time").cast("timestamp"))
    written = spark.read.schema(schemas.ENVELOPE).parquet(f"{tmp_path}/log")
    assert written.exceptAll(whole).count() == whole.exceptAll(written).count() == 0 < whole.count()


def test_the_shuffle_of_the_order_lines_carries_no_texts(spark, sf_dir):
    plan = views.market(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    lines = plan[plan.index("Exchange hashpartitioning(part_id") :]
    assert "l_partkey" in lines and " AS symbol" not in lines and " AS symbol" in plan


def test_errors_table(spark, tmp_path):
    rows = [sensor_message(START), ("k", "{broken", K.SENSOR_STREAM, 0, 1, START)]
    write_in_order([spark.createDataFrame(rows, schemas.ENVELOPE)], f"{tmp_path}/log")
    finish(job.start_job(messages.stream_files(spark, f"{tmp_path}/log"), f"{tmp_path}/t", f"{tmp_path}/c", NOW))
    bad = tables.read(spark, f"{tmp_path}/t/{K.ERROR_STREAM}").collect()
    assert [(row["key"], row["value"], row["error"]) for row in bad] == [("k", "{broken", "malformed value")]
    assert tables.read(spark, f"{tmp_path}/t/processed_data").count() == 1


def test_failed_query_stops_the_others(spark, tmp_path):
    write_in_order([spark.createDataFrame([sensor_message(START)], schemas.ENVELOPE)], f"{tmp_path}/log")
    stream = messages.stream_files(spark, f"{tmp_path}/log")

    def fail(batch, batch_id):
        raise ValueError("no room")

    steady = {"processingTime": "1 second"}
    queries = {
        "good": sinks.table_sink(messages.decode(stream), f"{tmp_path}/t", f"{tmp_path}/c1", trigger=steady),
        "bad": stream.writeStream.foreachBatch(fail).option("checkpointLocation", f"{tmp_path}/c2").start(),
    }
    with pytest.raises(Exception, match="no room"):
        job.await_all(spark, queries)
    assert not any(query.isActive for query in queries.values())


def test_a_foreign_failure_before_does_not_count(spark, tmp_path):
    write_in_order([spark.createDataFrame([sensor_message(START)], schemas.ENVELOPE)], f"{tmp_path}/log")
    stream = messages.stream_files(spark, f"{tmp_path}/log")

    def fail(batch, batch_id):
        raise ValueError("another job")

    lost = stream.writeStream.foreachBatch(fail).option("checkpointLocation", f"{tmp_path}/c1").start()
    with pytest.raises(Exception, match="another job"):
        lost.awaitTermination()
    sink = sinks.table_sink(messages.decode(stream), f"{tmp_path}/t", f"{tmp_path}/c2", trigger=NOW)
    job.await_all(spark, {"good": sink})
    assert tables.read(spark, f"{tmp_path}/t").count() == 1


def readings(spark, per_key, path, parts):
    rows = []
    for key, values in per_key.items():
        rows += [(key, START + dt.timedelta(seconds=30 * i), len(rows) + i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "key string, timestamp timestamp, id long, value double")
    longest = max(map(len, per_key.values()))
    edges = [START + dt.timedelta(seconds=30 * longest * i / parts) for i in range(parts + 1)]
    write_in_order([df.filter(F.col("timestamp").between(a, b - dt.timedelta(microseconds=1))) for a, b in zip(edges, edges[1:])], path)
    return df


@pytest.mark.parametrize("method", ["zscore", "moving_average"])
def test_scores_carry_over_batches(spark, tmp_path, method):
    random = np.random.default_rng(11)
    values = random.normal(50, 5, 330)
    values[::60] += 80
    data = {
        "a": values.tolist(),
        "constant": [0.1] * 120,
        "few": [1.0] * 10 + [90.0],
        "dirty": [None if i % 5 == 2 else float(i % 4) for i in range(60)],
    }
    df = readings(spark, data, f"{tmp_path}/log", 3)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
    scored = state.score_stream(stream, "key", "value", ["timestamp", "id"], method)
    sinks.table_sink(scored, f"{tmp_path}/t", f"{tmp_path}/c", trigger=NOW).awaitTermination()
    out = {row["id"]: row for row in tables.read(spark, f"{tmp_path}/t").collect()}
    rule = sequential.zscore if method == "zscore" else sequential.moving_average
    batch = detect.zscore if method == "zscore" else detect.moving_average
    in_batch = {row["id"]: row for row in batch(df, "key", "value", ["timestamp", "id"]).collect()}
    assert len(out) == df.count()
    number = 0
    for key, series in data.items():
        for score, flag in rule(series):
            row = out[number]
            assert row["anomaly_score"] == pytest.approx(score, abs=1e-9), (key, number)
            assert in_batch[number]["anomaly_score"] == pytest.approx(score, abs=1e-9)
            assert row["is_anomaly"] == flag, (key, number)
            number += 1


def test_cooldown_carries_over_batches(spark, tmp_path):
    random = np.random.default_rng(5)
    data = {"a": random.uniform(size=400).tolist(), "b": random.uniform(size=50).tolist()}
    df = readings(spark, data, f"{tmp_path}/log", 4).filter("value > 0.4")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
    sent = state.cooldown_stream(stream.filter("value > 0.4"), "key", ["timestamp", "id"], 15)
    sinks.table_sink(sent, f"{tmp_path}/t", f"{tmp_path}/c", trigger=NOW).awaitTermination()
    got = {row["id"] for row in tables.read(spark, f"{tmp_path}/t").collect()}
    assert got == {row["id"] for row in cooldown.cooldown(df, "key", ["timestamp", "id"], 15).collect()}


def test_a_key_comes_sorted_and_in_pieces_after_a_restart_too(spark, tmp_path):
    """Spark sorts a micro-batch by key and order above its one shuffle; with another number of partitions than the checkpoint's there are two."""
    values = np.random.default_rng(3).normal(50, 5, 700)
    values[::50] += 90
    rows = [("a", START + dt.timedelta(seconds=30 * i), i, float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "key string, timestamp timestamp, id long, value double")
    halves = [df.filter("id < 300").orderBy(F.rand(1)), df.filter("id >= 300").orderBy(F.rand(2))]
    session = spark.newSession()
    session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    for half, partitions in zip(halves, (5, 3)):
        session.conf.set("spark.sql.shuffle.partitions", partitions)
        write_in_order([half], f"{tmp_path}/log")
        stream = session.readStream.schema(df.schema).parquet(f"{tmp_path}/log")
        scored = state.score_stream(stream, "key", "value", ["timestamp", "id"])
        query = sinks.table_sink(scored, f"{tmp_path}/t", f"{tmp_path}/c", trigger=NOW)
        query.awaitTermination()
        plan = query._jsq.streamingQuery().lastExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(key") == (1 if partitions == 5 else 2)
        assert [line for line in plan.splitlines() if "Sort [key" in line and "timestamp" in line]
    out = {row["id"]: row for row in tables.read(spark, f"{tmp_path}/t").collect()}
    assert len(out) == len(values)
    for i, (score, flag) in enumerate(sequential.zscore(values.tolist())):
        assert out[i]["anomaly_score"] == pytest.approx(score, abs=1e-9) and out[i]["is_anomaly"] == flag


def test_steps_hold_one_frame_of_a_key():
    """What a frame gives comes out before the next one is asked for."""

    class Held:
        value = ()

        def get(self):
            return self.value

        def exists(self):
            return bool(self.value)

        def put(self, value):
            self.value = value

        update = put

    class Handle(Held):
        timers = ()

        def getListState(self, *_):
            return Held()

        getValueState = getListState

        def registerTimer(self, at):
            self.timers = (*self.timers, at)

    class Clock:
        def getCurrentWatermarkInMs(self):
            return 0

    asked = []

    def frames():
        for i in range(3):
            asked.append(i)
            times = [(3 * i + j) * 60_000_000 for j in range(3)]
            yield pd.DataFrame({"c0": times, "number": [1.0, 2.0, 3.0], "micros": times})

    for step in (chained.Scorer(["c0"], "c0", 4, 3.0), chained.Cooldown(["c0"], 120_000_000)):
        asked.clear()
        step.init(Handle())
        found = step.handleInputRows("k", frames(), Clock())
        first = next(found)
        assert asked == [0]
        rest = pd.concat([first, *found])
        assert asked == [0, 1, 2]
        if isinstance(step, chained.Cooldown):
            assert rest["c0"].tolist() == [i * 120_000_000 for i in range(5)] and step.last.get() == (480_000_000,)
            assert step.handle.timers == (600_001,)
        else:
            assert len(rest) == 9 and step.held.get() == [(3.0,), (1.0,), (2.0,), (3.0,)]
    with pytest.raises(RuntimeError, match="out of the order"):
        list(state.rising(iter([pd.DataFrame({"t": [2, 3]}), pd.DataFrame({"t": [1]})]), "t"))


def test_chained_alerts_equal_batch_after_a_restart(spark, tmp_path):
    """Scoring and cooldown in one query, which stops after half of the files and goes on from its checkpoint."""
    random = np.random.default_rng(7)
    values = random.normal(50, 5, (2, 300))
    values[:, 40::23] += 90
    data = {"a": values[0].tolist(), "b": values[1].tolist(), "dirty": [None if i % 5 == 2 else 900.0 * (i % 47 == 46) + i % 4 for i in range(120)]}
    df = readings(spark, data, f"{tmp_path}/first", 4).withColumns({"source": F.lit("s"), "number": F.lit(1), "_x": F.lit(2), "a b": F.lit(3)})
    order, edge = ["timestamp", "id"], START + dt.timedelta(minutes=75)
    timeless = df.limit(3).withColumn("timestamp", F.lit(None).cast("timestamp"))
    sent = alerts.score_to_alerts(df, "key", "value", order).collect()
    for rows in (df.filter(F.col("timestamp") < edge).union(timeless), df.filter(F.col("timestamp") >= edge)):
        write_in_order([rows], f"{tmp_path}/log")
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
        alerting.start_chained(stream, "key", "value", order, f"{tmp_path}/t", f"{tmp_path}/c", trigger=NOW).awaitTermination()
    got = tables.read(spark, f"{tmp_path}/t").collect()
    assert sorted((r.id, r.alert_key, round(r.anomaly_score, 9)) for r in got) == sorted((r.id, r.alert_key, round(r.anomaly_score, 9)) for r in sent)
    assert {(r["_x"], r["a b"], r.number) for r in got} == {(2, 3, 1)}
    assert 3 < len(sent) and {r.key for r in sent} == set(data)
    assert spark.conf.get(chained.PROVIDER) != chained.ROCKSDB  # the session keeps its own state store


def test_chained_cooldown_forgets_quiet_keys(spark, tmp_path):
    parts = [[("a", 0), ("b", 0)], [("b", 40)], [("b", 80)], [("b", 120)]]
    frames = [
        spark.createDataFrame([(k, START + dt.timedelta(minutes=m), i) for i, (k, m) in enumerate(part)], "key string, timestamp timestamp, id long")
        for part in parts
    ]
    write_in_order(frames, f"{tmp_path}/log")
    stream = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
    sent = chained.cooled_down(stream.withWatermark("timestamp", K.WATERMARK), "key", ["timestamp", "id"], 15)
    with chained.rocksdb_state(spark):
        query = sinks.table_sink(sent, f"{tmp_path}/t", f"{tmp_path}/c", trigger=NOW)
    query.awaitTermination()
    assert tables.read(spark, f"{tmp_path}/t").count() == 5
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] > 0


def test_cooldown_state_is_dropped_after_its_time(spark, tmp_path):
    """A key that went quiet leaves no state once the watermark passes its cooldown."""
    parts = [[("a", 0), ("b", 0)], [("b", 40)], [("b", 80)], [("b", 120)]]
    frames = [
        spark.createDataFrame(
            [(k, START + dt.timedelta(minutes=m), i) for i, (k, m) in enumerate(part)], "key string, timestamp timestamp, id long"
        )
        for part in parts
    ]
    write_in_order(frames, f"{tmp_path}/log")
    stream = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
    query = sinks.table_sink(
        state.cooldown_stream(stream, "key", ["timestamp", "id"], 15), f"{tmp_path}/t", f"{tmp_path}/c", trigger=NOW
    )
    query.awaitTermination()
    assert tables.read(spark, f"{tmp_path}/t").count() == 5
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 1


def test_monitor_counts_every_batch_and_failures(spark, tmp_path):
    """110 batches, more than a query keeps progress of; each but the first two has one row that comes too late."""
    from tidewatch.streaming.monitor import Monitor, totals

    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", "1")
    monitor, folder, batches = Monitor(), f"{tmp_path}/in", 110
    rows = [(START + dt.timedelta(hours=i), i, i) for i in range(batches)] + [(START - dt.timedelta(days=9), -1 - i, i) for i in range(batches)]
    made = session.createDataFrame(rows, "timestamp timestamp, id long, batch int")
    made.repartitionByRange(batches, "batch").sortWithinPartitions("batch").write.parquet(folder)
    from tidewatch.sources import files

    for age, name in enumerate(files.data_files(session, folder)):
        files.set_age(session, name, age)
    session.streams.addListener(monitor)
    try:
        stream = session.readStream.schema(made.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        counted = stream.withWatermark("timestamp", "1 minute").groupBy(F.window("timestamp", "1 minute")).count()
        query = counted.writeStream.format("noop").queryName("counted").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination()
        assert monitor.wait(query)
        found = len(files.data_files(session, folder))
        assert len([row for row in monitor._batches.values() if row[3]]) == found > 100
        assert monitor.dropped_late(query) == batches - 2 > job.dropped_late_rows(query)

        def fail(batch, batch_id):
            raise ValueError("no good")

        broken = stream.writeStream.foreachBatch(fail).option("checkpointLocation", f"{tmp_path}/d").start()
        with pytest.raises(Exception, match="no good"):
            broken.awaitTermination()
        assert monitor.wait(broken)
        for _ in range(2):
            monitor.save(session, f"{tmp_path}/monitor")
        kept = {row["query"]: row for row in totals(session, f"{tmp_path}/monitor").collect()}
        assert kept["counted"]["sum(dropped_late)"] == batches - 2
        assert kept["counted"]["sum(rows)"] == 2 * batches
        assert sum(row["count(failure)"] for row in kept.values()) == 1
    finally:
        session.streams.removeListener(monitor)
