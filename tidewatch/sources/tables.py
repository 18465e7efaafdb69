"""Stored tables: Parquet files under committed versions.

A change of a table is one new version, whatever it does: append, a repeated
micro-batch, compaction, removal by age, keyed changes. Each file is known by its
least and greatest event time and creation time, so that age rules drop whole files,
recency reads open only files that can hold such rows, and the newest rows are found in
the newest files. Backfills are written in order of time, which keeps these ranges apart.
"""

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch import constants as K
from tidewatch.functions.text import stored_name
from tidewatch.operators.lifecycle import not_older_than, upsert, with_created
from tidewatch.sources import versions
from tidewatch.sources.versions import NO_BATCH, File

CREATED = "created_at"


def zones_of(df: DataFrame, time: str | None, others: Sequence[str] = ()) -> list[str]:
    wanted = [time, CREATED, *others]
    return [name for i, name in enumerate(wanted) if name in df.columns and name not in wanted[:i]]


def insert(df: DataFrame, path: str, time: str = "timestamp", as_of=None, keys: Sequence[str] = ()) -> None:
    """Append rows. Files are known by their range of `keys` too, for keyed changes."""
    rows = with_created(df, as_of)
    added = versions.write_files(rows, path, zones_of(rows, time, keys))
    versions.commit(df.sparkSession, path, rows.schema, added)


def write_batch(
    df: DataFrame, batch_id: int, path: str, time: str = "timestamp", backfill: bool = False
) -> list[File]:
    """Write a micro-batch and say in which files. A batch that runs again after a failure takes the place of
    what it wrote before, in one version, so no row is stored twice. For that the
    stream itself sets `created_at`: its clock repeats with the batch.

    A live batch covers a short time and is written as it lies. A backfill is first
    brought into time order over the tasks; the hash splits rows of one time.
    """
    rows = with_created(df)
    kept = rows.persist() if backfill else None  # finding the ranges reads the rows once more
    try:
        if backfill:
            rows = rows.repartitionByRange(time, F.xxhash64(*df.columns))
        added = versions.write_files(rows, path, zones_of(rows, time), batch_id)
    finally:
        if kept is not None:
            kept.unpersist()
    versions.commit(df.sparkSession, path, rows.schema, added, lambda file: file.batch == batch_id)
    return added


def listed(spark: SparkSession, path: str) -> tuple[File, ...]:
    """The files of the newest version."""
    now = versions.newest(spark, path)
    return now.files if now else ()


def read(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A stored table; with its schema named, also one nothing was written to."""
    now = versions.newest(spark, path)
    if now is None:
        if schema is None:
            raise FileNotFoundError(f"no table was stored at {path}")
        return spark.createDataFrame([], schema)
    return versions.read_files(spark, schema or now.schema, now.files)


def read_since(spark: SparkSession, path: str, since: dt.datetime, time: str = "timestamp") -> DataFrame:
    """Rows of a time or later, from the files that can hold any."""
    now = versions.newest(spark, path)
    if now is None:
        raise FileNotFoundError(f"no table was stored at {path}")
    first = versions.micros(since)
    chosen = [file for file in now.files if time not in file.high or _or(file.high[time], first - 1) >= first]
    return versions.read_files(spark, now.schema, chosen).where(F.col(time) >= F.lit(since))


def _or(value, default):
    return default if value is None else value


def newest_files(found: Sequence[File], time: str, rows: int) -> list[File]:
    """The fewest files, latest first, that hold `rows` rows."""
    order = sorted(found, key=lambda file: _or(file.high.get(time), -(2**63)), reverse=True)
    taken: list[File] = []
    for file in order:
        if sum(f.rows for f in taken) >= rows:
            break
        taken.append(file)
    return taken


def read_newest(spark: SparkSession, path: str, limit: int, tie: Sequence[str] = (), time: str = "timestamp") -> DataFrame:
    """The `limit` newest rows, by time and then by `tie`, both descending.

    The latest files that hold enough rows give a time that the last row wanted cannot
    lie before; every file that reaches it is read, and no other. Rows without a time
    come last.
    """
    now = versions.newest(spark, path)
    if now is None:
        raise FileNotFoundError(f"no table was stored at {path}")
    order = [F.desc(time), *[F.desc(name) for name in tie]]
    first = newest_files(now.files, time, limit)
    chosen = list(now.files)
    if limit and first:
        times = versions.read_files(spark, now.schema, first).select(time).where(F.col(time).isNotNull())
        edge = times.orderBy(F.desc(time)).limit(limit).agg(F.count(time), F.unix_micros(F.min(time).cast("timestamp"))).first()
        if edge[0] == limit:
            chosen = [file for file in now.files if time not in file.high or _or(file.high[time], edge[1] - 1) >= edge[1]]
    return versions.read_files(spark, now.schema, chosen).orderBy(*order).limit(limit)


def read_named(spark: SparkSession, root: str, name: str, prefix: str = "tidewatch_") -> DataFrame:
    """A stored table by its name, with or without the prefix that tables carry."""
    return read(spark, f"{root}/{stored_name(name, prefix)}")


def files_until(spark: SparkSession, path: str, cutoff: dt.datetime) -> tuple[list[File], list[File]]:
    """Files whose rows were all created before a moment, and files of which some were."""
    end, whole, partly = versions.micros(cutoff), [], []
    for file in listed(spark, path):
        low, high = file.low.get(CREATED), file.high.get(CREATED)
        if low is not None and low < end:
            (whole if high < end else partly).append(file)
    return whole, partly


def read_files(spark: SparkSession, path: str, chosen: Sequence[File]) -> DataFrame:
    """Certain files of a table."""
    now = versions.newest(spark, path)
    return versions.read_files(spark, now.schema, chosen)


def replace_files(spark: SparkSession, path: str, removed: Sequence[File], kept: DataFrame, time: str | None = "timestamp") -> None:
    """Put the rows of `kept` in the place of certain files, in one version.

    Files that come meanwhile are not touched. If another writer has replaced one of
    them meanwhile, nothing is changed and it is an error.
    """
    names = list(removed[0].high) if removed else zones_of(kept, time)
    added = versions.write_files(kept, path, [name for name in names if name in kept.columns])
    versions.commit(spark, path, kept.schema, added, removed=removed)


def compact(spark: SparkSession, path: str, before_batch: int, time: str = "timestamp") -> None:
    """Put the files that the batches before `before_batch` wrote into few, in order of
    time. Batches that may still run again must not be among them: name the first one
    that the stream has not yet committed."""
    chosen = [file for file in listed(spark, path) if file.batch < before_batch]
    if len(chosen) > 1:
        rows = read_files(spark, path, chosen)
        replace_files(spark, path, chosen, rows.repartitionByRange(time, F.xxhash64(*rows.columns)).sortWithinPartitions(time))


def merge_files(
    spark: SparkSession, path: str, changes: DataFrame, key: str, merge: Callable[[DataFrame], DataFrame]
) -> list[File]:
    """Put `merge` of the rows of the files that hold a changed key in the place of these files.

    Files whose range of keys meets no change are left unread. Of the others the key column
    alone is read to find those that hold a changed key; no other file is opened or
    replaced. Returns the files replaced. A NULL key is in no range, so files are
    searched for it whatever their range.
    """
    now = versions.newest(spark, path)
    if now is None:
        raise FileNotFoundError(f"no table was stored at {path}")
    ends = changes.agg(F.min(key), F.max(key), F.count_if(F.col(key).isNull())).first()

    def may_hold(file: File) -> bool:
        if ends[2] or key not in file.low:
            return True
        low, high = file.low[key], file.high[key]
        return low is not None and ends[0] is not None and low <= ends[1] and ends[0] <= high

    near = [file for file in now.files if may_hold(file)]
    held = set()
    if near:
        wanted = changes.select(F.col(key).alias("_wanted")).distinct()
        keys = versions.read_files(spark, now.schema, near).select(key, "_metadata.file_path")
        found = keys.join(wanted, F.col(key).eqNullSafe(F.col("_wanted")), "left_semi")
        held = {row[0] for row in found.select("file_path").distinct().collect()}
    chosen = [file for file in near if file.name in held]
    changed = merge(versions.read_files(spark, now.schema, chosen))
    zones = list(now.files[0].high) if now.files else [key]
    added = versions.write_files(changed, path, [name for name in zones if name in changed.columns])
    versions.commit(spark, path, changed.schema, added, removed=chosen)
    return chosen


def upsert_files(
    spark: SparkSession, path: str, changes: DataFrame, key: str, as_of=None, insert_missing: bool = True, order: Sequence[str] = ()
) -> list[File]:
    """`lifecycle.upsert` on a stored table, by `merge_files`; keys that no file holds come in a new one."""
    return merge_files(spark, path, changes, key, lambda rows: upsert(rows, changes, key, as_of, insert_missing, order))


def remove_older(spark: SparkSession, path: str, days: float, as_of: dt.datetime) -> None:
    """Remove rows created more than `days` before `as_of`: files of only such rows leave
    the list, files of some are rewritten without them, in one version. Then the files
    that no version names any more are deleted."""
    whole, partly = files_until(spark, path, as_of - dt.timedelta(days=days))
    if whole or partly:
        kept = not_older_than(read_files(spark, path, partly), days, as_of)
        if partly:
            replace_files(spark, path, [*whole, *partly], kept)
        else:
            versions.commit(spark, path, kept.schema, [], removed=whole)
    versions.vacuum(spark, path)


def enforce_retention(
    spark: SparkSession, root: str, as_of: dt.datetime, retention: dict[str, int] | None = None
) -> None:
    """Apply each table's retention."""
    for name, days in (retention or K.RETENTION_DAYS).items():
        remove_older(spark, f"{root}/{name}", days, as_of)
