"""Tables, keyed changes, retention, archives, snapshots, objects."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import lifecycle
from tidewatch.plans import views
from tidewatch.sources import archive, files, objects, snapshots, tables, versions
from tidewatch.streaming import sinks

NOW = dt.datetime(2024, 3, 1, 12, 0, 0)
SCHEMA = "id long, timestamp timestamp, value double, created_at timestamp"


def aged(spark, days):
    rows = [(i, NOW - dt.timedelta(days=d), float(i), NOW - dt.timedelta(days=d)) for i, d in enumerate(days)]
    return spark.createDataFrame(rows, SCHEMA)


def ids(df):
    return sorted(row["id"] for row in df.collect())


def test_created_at_default(spark):
    df = spark.createDataFrame([(1, None), (2, NOW)], "id long, created_at timestamp")
    later = NOW + dt.timedelta(days=1)
    out = {row["id"]: row["created_at"] for row in lifecycle.with_created(df, later).collect()}
    assert out == {1: later, 2: NOW}
    assert lifecycle.with_created(df.drop("created_at"), NOW).first()["created_at"] == NOW


def test_age_rule_is_strict(spark):
    df = aged(spark, [6, 7, 7.0001, 8])
    assert ids(lifecycle.older_than(df, 7, NOW)) == [2, 3]
    assert ids(lifecycle.not_older_than(df, 7, NOW)) == [0, 1]


def test_upsert(spark):
    table = spark.createDataFrame(
        [("a", 1, "x", None), ("b", 2, "y", NOW)], "k string, n int, s string, updated_at timestamp"
    )
    changes = spark.createDataFrame([("a", None), ("c", 3)], "k string, n int")
    later = NOW + dt.timedelta(hours=1)
    out = {row["k"]: tuple(row)[1:] for row in lifecycle.upsert(table, changes, "k", later).collect()}
    assert out == {"a": (None, "x", later), "b": (2, "y", NOW), "c": (3, None, later)}
    out = lifecycle.upsert(table, changes, "k", later, insert_missing=False)
    assert sorted(row["k"] for row in out.collect()) == ["a", "b"]


def test_delete(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 5)], "id long, v int")
    assert ids(lifecycle.delete_where(df, F.col("v") == 5)) == [2]
    assert ids(lifecycle.delete_one(df, F.col("v") == 5, ["id"])) == [2, 3]
    assert ids(lifecycle.delete_one(df, F.col("v") == 6, ["id"])) == [1, 2, 3]


def test_batch_written_twice_is_stored_once(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_batch(aged(spark, [0, 1]), 0, path)
    tables.write_batch(aged(spark, [0, 1, 2]), 1, path)
    tables.write_batch(aged(spark, [0, 1, 2]), 1, path)
    assert ids(tables.read(spark, path)) == [0, 0, 1, 1, 2]


def test_retention_removes_exactly_the_old_rows(spark, tmp_path):
    days = [0, 29, 29.9, 30, 30.1, 30.4, 30.6, 31, 89, 91, 364, 366]
    for name in ("processed_data", "aggregated_data", "anomalies"):
        tables.insert(aged(spark, days), f"{tmp_path}/{name}")
    tables.enforce_retention(spark, str(tmp_path), NOW)
    kept = {n: ids(tables.read(spark, f"{tmp_path}/{n}")) for n in ("processed_data", "aggregated_data", "anomalies")}
    assert kept == {
        "processed_data": [0, 1, 2, 3],
        "aggregated_data": list(range(9)),
        "anomalies": list(range(11)),
    }
    tables.enforce_retention(spark, str(tmp_path), NOW)
    assert ids(tables.read(spark, f"{tmp_path}/processed_data")) == [0, 1, 2, 3]


@pytest.mark.parametrize("key", [None, "id"])
def test_archive_and_restore(spark, tmp_path, key):
    root, archives = f"{tmp_path}/tables", f"{tmp_path}/store"
    tables.insert(aged(spark, [0, 6.9, 7, 7.1, 7.4, 8, 20]), f"{root}/processed_data")
    entry = archive.archive_old(spark, root, "processed_data", archives, NOW, key=key).collect()[0]
    assert (entry["collection"], entry["record_count"]) == ("processed_data", "4")
    assert entry["archive_date"] == "20240301120000" and entry["cutoff_date"] == "2024-02-23T12:00:00"
    assert ids(tables.read(spark, f"{root}/processed_data")) == [0, 1, 2]
    assert archive.manifest(spark, archives).count() == 1
    names = [row["key"] for row in objects.list_objects(spark, entry["path"]).collect()]
    assert any(name.endswith(".json.gz") for name in names)

    schema = aged(spark, [0]).schema
    for _ in range(2):
        archive.restore(spark, entry["path"], root, schema, "id")
    back = tables.read(spark, f"{root}/processed_data").select("id", "timestamp", "value", "created_at")
    want = aged(spark, [0, 6.9, 7, 7.1, 7.4, 8, 20])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, want.collect()))


def test_nothing_old_writes_no_archive(spark, tmp_path):
    tables.insert(aged(spark, [0, 1]), f"{tmp_path}/t/processed_data")
    assert archive.archive_old(spark, f"{tmp_path}/t", "processed_data", f"{tmp_path}/s", NOW) is None
    assert ids(tables.read(spark, f"{tmp_path}/t/processed_data")) == [0, 1]
    assert not files.folders(spark, f"{tmp_path}/s/archives/processed_data")


def test_reconcile_keeps_rows_the_archive_lacks(spark):
    df = aged(spark, [1, 8, 9, 10])
    assert ids(lifecycle.reconcile(df, df.filter("id = 2"), "id", 7, NOW)) == [0, 1, 3]


def test_snapshots(spark, tmp_path):
    root = str(tmp_path)
    assert snapshots.load_snapshot(spark, root, "a") is None
    assert snapshots.list_snapshots(spark, root).count() == 0
    for size in (1, 2, 3):
        assert snapshots.save_snapshot(aged(spark, range(size)), root, "a") == size
    snapshots.save_snapshot(aged(spark, range(5)), root, "b")
    assert [row["version"] for row in snapshots.list_snapshots(spark, root, "a").collect()] == [3, 2, 1]
    assert snapshots.list_snapshots(spark, root).count() == 4
    assert snapshots.load_snapshot(spark, root, "a").count() == 3
    assert snapshots.load_snapshot(spark, root, "a", 1).count() == 1
    assert snapshots.load_snapshot(spark, root, "a", 9) is None
    assert snapshots.delete_snapshot(spark, root, "a", 3)
    assert not snapshots.delete_snapshot(spark, root, "a", 3)
    assert snapshots.load_snapshot(spark, root, "a").count() == 2
    counts = [row["record_count"] for row in snapshots.list_snapshots(spark, root, "a").collect()]
    assert counts == [2, 1]


def test_changes_make_a_new_version(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(ValueError):
        snapshots.change_snapshot(spark, root, "a", lambda df: df)
    snapshots.save_snapshot(aged(spark, [0, 1]), root, "a")
    changes = spark.createDataFrame([(1, 7.5), (9, 9.5)], "id long, value double")
    assert snapshots.change_snapshot(spark, root, "a", lambda df: lifecycle.upsert(df, changes, "id", NOW)) == 2
    assert snapshots.change_snapshot(spark, root, "a", lambda df: lifecycle.delete_where(df, F.col("id") == 0)) == 3
    latest = {row["id"]: row["value"] for row in snapshots.load_snapshot(spark, root, "a").collect()}
    assert latest == {1: 7.5, 9: 9.5}
    assert ids(snapshots.load_snapshot(spark, root, "a", 1)) == [0, 1]


def test_snapshot_without_entry_is_not_seen(spark, tmp_path):
    root = str(tmp_path)
    snapshots.save_snapshot(aged(spark, [0]), root, "a")
    aged(spark, [0, 1]).write.parquet(f"{root}/a/version=2")
    assert snapshots.load_snapshot(spark, root, "a").count() == 1
    assert snapshots.save_snapshot(aged(spark, [0, 1, 2]), root, "a") == 2
    assert snapshots.load_snapshot(spark, root, "a").count() == 3


def test_empty_snapshot(spark, tmp_path):
    empty = aged(spark, [0]).filter("id > 5")
    assert snapshots.save_snapshot(empty, str(tmp_path), "e") == 1
    assert snapshots.load_snapshot(spark, str(tmp_path), "e").count() == 0


def test_objects(spark, tmp_path):
    for name, data in {"a/1.bin": b"one", "a/2.bin": b"second", "b/3.bin": b"x"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    listed = objects.list_objects(spark, f"{tmp_path}/a").collect()
    assert [(row["key"].rsplit("/", 1)[1], row["size"]) for row in listed] == [("1.bin", 3), ("2.bin", 6)]
    assert objects.list_objects(spark, str(tmp_path), 2).count() == 2
    assert objects.list_objects(spark, str(tmp_path), None).count() == 3
    assert bytes(objects.object_bytes(spark, f"{tmp_path}/a/2.bin").collect()[0]["content"]) == b"second"


def test_rows_stored_after_the_archive_was_written_stay(spark, tmp_path):
    root = f"{tmp_path}/tables"
    tables.insert(aged(spark, [0, 7.2, 9]), f"{root}/t")
    late = aged(spark, [9.5, 7.1]).withColumn("id", F.col("id") + 10)
    archive.archive_old(
        spark, root, "t", f"{tmp_path}/s", NOW, before_removal=lambda: tables.insert(late, f"{root}/t")
    )
    assert ids(tables.read(spark, f"{root}/t")) == [0, 10, 11]


@pytest.mark.parametrize("work", ["retention", "compact", "batch", "upsert", "archive"])
def test_a_failure_after_any_step_leaves_each_row_once(spark, tmp_path, monkeypatch, work):
    """The steps are what changes the file system: after each of them in turn the job dies, and is run again."""
    path = f"{tmp_path}/store/t"
    changes = spark.createDataFrame([(1, 99.0), (7, 77.0)], "id long, value double")

    def build():
        for batch in range(3):
            tables.write_batch(aged(spark, [6.9, 7.1]).withColumn("id", F.col("id") + 2 * batch), batch, path)

    def run():
        if work == "retention":
            tables.remove_older(spark, path, 7, NOW)
        elif work == "compact":
            tables.compact(spark, path, before_batch=3)
        elif work == "batch":
            tables.write_batch(aged(spark, [6.9, 7.1]), 0, path)
        elif work == "upsert":
            tables.upsert_files(spark, path, changes, "id", NOW)
        else:
            archive.archive_old(spark, f"{tmp_path}/store", "t", f"{tmp_path}/archive", NOW)

    def rows():
        return sorted((row["id"], row["value"]) for row in tables.read(spark, path).select("id", "value").collect())

    build()
    before = rows()
    real = {name: getattr(files, name) for name in ("create_once", "remove")}
    real_write = versions.write_files
    state = {"left": 0}

    def dying(step):
        def call(*args, **kwargs):
            out = step(*args, **kwargs)
            state["left"] -= 1
            if state["left"] == 0:
                raise KeyboardInterrupt("lost")
            return out

        return call

    for name, step in real.items():
        monkeypatch.setattr(files, name, dying(step))
    monkeypatch.setattr(versions, "write_files", dying(real_write))
    seen, died = [before], 1
    while True:
        state["left"] = died
        try:
            run()
            break
        except KeyboardInterrupt:
            seen.append(rows())  # what a reader finds after the failure
            died += 1
    after = rows()
    assert died > 2 or work == "batch"
    assert len({tuple(found) for found in seen} - {tuple(before), tuple(after)}) == 0
    want = {
        "retention": [row for row in before if row[0] % 2 == 0],
        "archive": [row for row in before if row[0] % 2 == 0],
        "upsert": sorted([(1, 99.0), (7, 77.0), *[row for row in before if row[0] != 1]]),
    }
    assert after == want.get(work, before)


def test_writers_at_the_same_time_both_get_a_version(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    tables.insert(aged(spark, [1, 9]), path)
    real, other = files.create_once, aged(spark, [2]).withColumn("id", F.lit(5).cast("long"))

    def late(*args):
        monkeypatch.setattr(files, "create_once", real)
        tables.insert(other, path)  # another writer is first
        return real(*args)

    monkeypatch.setattr(files, "create_once", late)
    tables.remove_older(spark, path, 7, NOW)
    assert ids(tables.read(spark, path)) == [0, 5]
    old = tables.listed(spark, path)
    tables.compact(spark, path, before_batch=1)
    with pytest.raises(versions.Conflict):
        tables.replace_files(spark, path, old, aged(spark, [1]))
    assert ids(tables.read(spark, path)) == [0, 5]


def test_a_version_reads_the_same_while_the_table_changes(spark, tmp_path):
    path = f"{tmp_path}/t"
    tables.insert(aged(spark, [1, 2]), path)
    rows = tables.read(spark, path)
    tables.insert(aged(spark, [3]).withColumn("extra", F.lit("x")), path)
    assert rows.count() == 2
    back = tables.read(spark, path)
    assert back.columns == ["id", "timestamp", "value", "created_at", "extra"]
    assert sorted(row["extra"] or "" for row in back.collect()) == ["", "", "x"]
    with pytest.raises(ValueError):
        tables.insert(aged(spark, [1]).withColumn("value", F.lit("text")), path)


def opened(df):
    """The files that a plan would read."""
    return len(df.inputFiles())


def test_newest_rows_come_from_few_of_many_files(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = spark.range(4000).select(
        "id", (F.timestamp_seconds(F.lit(1_700_000_000) + F.floor(F.col("id") / 3))).alias("timestamp"), F.lit(NOW).alias("created_at")
    )
    tables.insert(rows.repartitionByRange(200, "timestamp"), path)
    assert len(tables.listed(spark, path)) > 190
    out = tables.read_newest(spark, path, 50, ["id"])
    assert [row["id"] for row in out.collect()] == list(range(3999, 3949, -1))
    assert opened(out) <= 5
    assert tables.read_newest(spark, path, 0).count() == 0
    assert tables.read_newest(spark, path, 9999, ["id"]).count() == 4000
    since = dt.datetime(2023, 11, 14, 22, 13, 20) + dt.timedelta(seconds=1300)
    recent = tables.read_since(spark, path, since)
    assert recent.count() == 4000 - 3900
    assert opened(recent) <= 8
    untimed = rows.limit(3).withColumn("timestamp", F.lit(None).cast("timestamp"))
    tables.insert(untimed, path)
    assert opened(tables.read_newest(spark, path, 50, ["id"])) <= 5
    assert tables.read_newest(spark, path, 4003).where("timestamp IS NULL").count() == 3


def test_upsert_rewrites_only_files_that_hold_a_changed_key(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = spark.range(1000).select(F.col("id").alias("k"), F.lit(0).alias("n"), F.lit(NOW).alias("timestamp"))
    tables.insert(rows.repartitionByRange(20, "k"), path, keys=["k"], as_of=NOW)
    before = {file.name for file in tables.listed(spark, path)}
    changes = spark.createDataFrame([(3, 7), (990, 8), (5000, 9)], "k long, n int")
    replaced = tables.upsert_files(spark, path, changes, "k", NOW)
    after = {file.name for file in tables.listed(spark, path)}
    assert len(replaced) == 2
    assert before - after == {file.name for file in replaced}
    out = {row["k"]: row["n"] for row in tables.read(spark, path).collect()}
    assert out == {**{k: 0 for k in range(1000)}, 3: 7, 990: 8, 5000: 9}
    none = spark.createDataFrame([(None, 4)], "k long, n int")
    assert tables.upsert_files(spark, path, none, "k", NOW) == []
    assert len(tables.upsert_files(spark, path, none, "k", NOW)) == 1
    assert tables.read(spark, path).count() == 1002


def test_upsert_takes_the_last_of_repeated_changes_and_null_keys(spark):
    table = spark.createDataFrame([("a", 1), (None, 2)], "k string, n int")
    changes = spark.createDataFrame([("a", 5, 2), ("a", 9, 1), (None, 7, 1), ("b", 3, 1), ("b", 4, 1)], "k string, n int, at int")
    out = lifecycle.upsert(table, changes, "k", NOW, order=["at"]).collect()
    assert sorted(((row["k"], row["n"]) for row in out), key=str) == [("a", 5), ("b", 4), (None, 7)]


def test_update_of_the_first_match(spark):
    table = spark.createDataFrame([(1, 5), (2, 5), (3, None)], "id long, v int")
    out = lifecycle.update_first(table, F.col("v") == 5, {"v": F.lit(6)}, ["id"], NOW)
    assert [(r["id"], r["v"], r["updated_at"]) for r in out.orderBy("id").collect()] == [(1, 6, NOW), (2, 5, None), (3, None, None)]
    for insert, count in ((None, 3), ({"id": F.lit(9).cast("long")}, 4)):
        out = lifecycle.update_first(table, F.col("v") == 8, {"v": F.lit(6)}, ["id"], NOW, insert)
        assert out.count() == count
    assert out.filter("id = 9").first()["v"] == 6
    assert lifecycle.update_first(table, F.col("v") == 5, {"v": F.lit(6)}, ["id"], NOW, {"id": F.lit(9)}).count() == 3


def test_objects_by_key_prefix(spark, tmp_path):
    for name in ("a/1.bin", "ab/2.bin", "b/1.bin"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    listed = objects.list_objects(spark, f"{tmp_path}/a").collect()
    assert [row["key"].rsplit("/", 2)[1:] for row in listed] == [["a", "1.bin"], ["ab", "2.bin"]]
    assert objects.list_objects(spark, f"{tmp_path}/a/1").count() == 1
    assert objects.list_objects(spark, f"{tmp_path}/none").count() == 0


def test_table_by_name(spark, tmp_path):
    tables.insert(aged(spark, [0, 1]), f"{tmp_path}/tidewatch_x")
    for name in ("x", "tidewatch_x"):
        assert ids(tables.read_named(spark, str(tmp_path), name)) == [0, 1]


def test_compaction_keeps_rows_and_spares_open_batches(spark, tmp_path):
    path = f"{tmp_path}/t"
    for batch in range(4):
        tables.write_batch(aged(spark, [0.1]).withColumn("id", F.lit(batch).cast("long")), batch, path)
    tables.compact(spark, path, before_batch=3)
    assert ids(tables.read(spark, path)) == [0, 1, 2, 3]
    assert len(tables.listed(spark, path)) == 2
    tables.write_batch(aged(spark, [0.1, 0.2]), 3, path)
    assert ids(tables.read(spark, path)) == [0, 0, 1, 1, 2]
    assert versions.vacuum(spark, path)
    assert ids(tables.read(spark, path)) == [0, 0, 1, 1, 2]


def test_stored_files_are_zstandard(spark, tmp_path):
    rows = spark.range(1000).select("id", F.lit(NOW).alias("timestamp"), F.lit("much the same text").alias("text"))
    tables.insert(rows, f"{tmp_path}/t")
    assert {file.name.endswith(".zstd.parquet") for file in tables.listed(spark, f"{tmp_path}/t")} == {True}
    assert tables.read(spark, f"{tmp_path}/t").select("id", "text").exceptAll(rows.select("id", "text")).count() == 0
    sinks.write_feed(rows, 7, f"{tmp_path}/feed")
    assert all(name.endswith(".txt.gz") for name in files.data_files(spark, f"{tmp_path}/feed") if "part-" in name)
    feed = spark.read.text(f"{tmp_path}/feed/batch_id=7")
    assert feed.count() == 1000 and json.loads(feed.first()[0])["text"] == "much the same text"


def test_price_updates_shuffle_the_order_lines_once(spark, sf_dir):
    session = spark.newSession()
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    session.conf.set("spark.sql.adaptive.enabled", "false")
    plan = views.market(session, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # the lines and the parts
