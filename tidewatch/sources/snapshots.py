"""Named, numbered versions of a table. Data is written first and its manifest
entry after, so a version that failed halfway is never seen; the latest version
is the highest one listed."""

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.sources import files

ENTRY = (
    T.StructType()
    .add("snapshot_id", "string")
    .add("name", "string")
    .add("version", "long")
    .add("saved_at", "timestamp")
    .add("record_count", "long")
    .add("path", "string")
)


def _versions(spark: SparkSession, root: str, name: str) -> list[int]:
    found = files.folders(spark, f"{root}/_entries/{name}")
    return sorted(int(folder.split("=", 1)[1]) for folder in found if folder.startswith("number="))


def save_snapshot(df: DataFrame, root: str, name: str) -> int:
    """Save a version and return its number."""
    spark = df.sparkSession
    version = max([0, *_versions(spark, root, name)]) + 1
    path = f"{root}/{name}/version={version}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
    row = (f"{name}_{version}", name, version, dt.datetime.now(), seen.get["rows"], path)
    entry = spark.createDataFrame([row], ENTRY).coalesce(1)
    entry.write.mode("overwrite").json(f"{root}/_entries/{name}/number={version}")
    return version


def list_snapshots(spark: SparkSession, root: str, name: str | None = None) -> DataFrame:
    """Saved versions, of one name or of all, newest first."""
    names = [name] if name else files.folders(spark, f"{root}/_entries")
    paths = [f"{root}/_entries/{n}/number={v}" for n in names for v in _versions(spark, root, n)]
    entries = spark.read.schema(ENTRY).json(paths) if paths else spark.createDataFrame([], ENTRY)
    return entries.orderBy(F.desc("saved_at"), F.desc("version"))


def load_snapshot(
    spark: SparkSession, root: str, name: str, version: int | None = None
) -> DataFrame | None:
    """A version, the latest by default; None if there is no such version."""
    versions = _versions(spark, root, name)
    version = version or (versions[-1] if versions else None)
    if version not in versions:
        return None
    return spark.read.parquet(f"{root}/{name}/version={version}")


def change_snapshot(
    spark: SparkSession, root: str, name: str, change: Callable[[DataFrame], DataFrame]
) -> int:
    """Save what `change` makes of the latest version (an upsert, a delete) as
    the next one. Readers of the old version are not disturbed."""
    latest = load_snapshot(spark, root, name)
    if latest is None:
        raise ValueError(f"no snapshot named {name}")
    return save_snapshot(change(latest), root, name)


def delete_snapshot(spark: SparkSession, root: str, name: str, version: int) -> bool:
    """Remove a version; the next highest becomes the latest."""
    if version not in _versions(spark, root, name):
        return False
    files.remove(spark, f"{root}/_entries/{name}/number={version}")
    files.remove(spark, f"{root}/{name}/version={version}")
    return True
