"""Stored objects: listing by prefix and whole-object reads."""

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.sources import files


def _objects(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


OBJECT = "key string, size long, last_modified timestamp"


def list_objects(spark: SparkSession, prefix: str, max_keys: int | None = 1000) -> DataFrame:
    """Key, size and time of change of all objects whose key begins with the
    prefix, none if there are none; contents are not read."""
    pattern = re.sub(r"([\[\]{}*?\\])", r"\\\1", prefix) + "*"
    if not files.matches(spark, pattern):
        return spark.createDataFrame([], OBJECT)
    listed = _objects(spark, pattern).select(
        F.col("path").alias("key"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("last_modified"),
    )
    ordered = listed.orderBy("key")
    return ordered if max_keys is None else ordered.limit(max_keys)


def object_bytes(spark: SparkSession, path: str) -> DataFrame:
    """The bytes of each object below a path, one row per object."""
    return _objects(spark, path).select(F.col("path").alias("key"), "content")
