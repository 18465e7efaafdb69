"""Reading the given tables and small column helpers for the text operators."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from tidewatch.session import ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: str | Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo `modulus`; a null key counts as empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def unused(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column of the table is called so."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def map_batches(
    df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType
) -> DataFrame:
    """`function` on each Arrow batch; empty batches are passed over."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield function(batch)

    return df.mapInArrow(run, schema)


def with_columns(
    df: DataFrame, function: Callable[[pa.RecordBatch], list[pa.Array]], added: dict[str, str]
) -> DataFrame:
    """The table with columns that `function` computes from each Arrow batch; `added` has their types."""
    schema = StructType(list(df.schema.fields))
    for name, kind in added.items():
        schema = schema.add(name, DataType.fromDDL(kind))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, *function(batch)], [*batch.schema.names, *added])

    return map_batches(df, run, schema)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """Texts of a batch; null is the empty text."""
    return [text or "" for text in batch.column(column).to_pylist()]


def lists(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from values end to end and the number that each row holds."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))
