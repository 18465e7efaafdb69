"""Archives: gzip JSON lines of old rows, a manifest, and restoring them."""

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch import constants as K
from tidewatch.functions.text import restore_target
from tidewatch.operators.lifecycle import not_older_than, older_than, reconcile
from tidewatch.sources import files, tables, versions
from tidewatch.sources.messages import JSON_TIMES

MANIFEST = (
    T.StructType()
    .add("collection", "string")
    .add("record_count", "string")
    .add("archive_date", "string")
    .add("cutoff_date", "string")
    .add("path", "string")
)


def write_archive(df: DataFrame, path: str) -> int:
    """Write rows as gzip JSON lines; the count comes from the same pass."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.options(**JSON_TIMES).option(
        "compression", "gzip"
    ).json(path)
    return seen.get["rows"]


def read_archive(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).options(**JSON_TIMES).json(path)


def archive_old(
    spark: SparkSession,
    root: str,
    name: str,
    archive_root: str,
    as_of: dt.datetime,
    days: float = K.ARCHIVE_DAYS,
    key: str | None = None,
    before_removal: Callable[[], None] | None = None,
) -> DataFrame | None:
    """Archive a table's rows older than `days`, then remove them.

    The files that can hold such rows are listed once. Exactly their old rows
    are archived, and exactly these files leave the table, their younger rows
    written anew, in one version; rows stored meanwhile lie in other files and
    stay. Removal waits until the archive reads back with every row written;
    with a `key`, rows whose key the archive lacks stay as well.
    `before_removal` is called between the two steps. Returns the manifest
    entry, None if nothing is old.
    """
    path = f"{root}/{name}"
    cutoff = as_of - dt.timedelta(days=days)
    whole, partly = tables.files_until(spark, path, cutoff)
    if not whole and not partly:
        return None
    listed = tables.read_files(spark, path, [*whole, *partly])
    stamp = as_of.strftime("%Y%m%d%H%M%S")
    target = _free_place(spark, archive_root, f"{archive_root}/archives/{name}/{stamp}")
    rows = older_than(listed, days, as_of)
    written = write_archive(rows, target)
    if not written:
        files.remove(spark, target)
        return None
    stored = read_archive(spark, target, rows.schema)
    if stored.count() != written:
        raise RuntimeError(f"archive {target} does not hold all {written} rows; nothing removed")
    entry = spark.createDataFrame(
        [(name, str(written), stamp, cutoff.isoformat(), target)], MANIFEST
    )
    entry.write.mode("append").json(f"{archive_root}/manifest")
    if before_removal:
        before_removal()
    kept = reconcile(listed, stored, key, days, as_of) if key else not_older_than(listed, days, as_of)
    tables.replace_files(spark, path, [*whole, *partly], kept)
    versions.vacuum(spark, path)
    return entry


def _free_place(spark: SparkSession, archive_root: str, path: str) -> str:
    """Where an archive can be written: what a failed run left there goes, what the manifest names stays."""
    known = {row["path"] for row in manifest(spark, archive_root).collect()} if files.exists(spark, f"{archive_root}/manifest") else set()
    place, number = path, 1
    while place in known:
        number += 1
        place = f"{path}-{number}"
    files.remove(spark, place)
    return place


def manifest(spark: SparkSession, archive_root: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{archive_root}/manifest")


def restore(
    spark: SparkSession,
    archive_path: str,
    root: str,
    schema: T.StructType,
    key: str,
    name: str | None = None,
    time: str = "timestamp",
) -> str:
    """Append an archive's rows to its table, by default the one its path names.
    Rows whose key the table holds already stay out, so it can run again."""
    target = f"{root}/{name or restore_target(archive_path, prefix='')}"
    rows = read_archive(spark, archive_path, schema)
    if tables.listed(spark, target):
        rows = rows.join(tables.read(spark, target).select(key), key, "left_anti")
    tables.insert(rows, target, time)
    return target
