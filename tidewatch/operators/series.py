"""Per-key series: bounded look-back over keys of any size, and latest rows."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import written_once

BLOCK = "_block"
CARRIED = "_carried"
POSITION = "_position"
BLOCK_ROWS = 1_000_000


def long_keys(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame | None:
    """The keys with more than `rows` rows and more than a shuffle partition's share, none if there are none.

    There are fewer of them than shuffle partitions, so they can be sent to every
    task. NULL is a key.
    """
    spark = df.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    top = counts.orderBy(F.desc("_rows")).limit(partitions)
    largest = [row for row in top.collect() if row["_rows"] > rows]
    if largest:
        share = df.count() / partitions
        largest = [row for row in largest if row["_rows"] > share]
    return spark.createDataFrame(largest, top.schema).drop("_rows") if largest else None


def in_blocks(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    lookback: int,
    align: int = 1,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Cut long series into blocks so that a window of `lookback` earlier rows stays exact.

    Rows are numbered from 1 along `order` within their key (`_position`). Keys that
    fit a task, by `long_keys`, are one block: a window over (keys, `_block`) takes
    one shuffle. The others go through `cut`. Run the window, then drop the carried
    rows with `drop_carried`.
    """
    keys, order = list(keys), list(order)
    long = long_keys(df, keys, block_rows)
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
    if long is None:
        return df.withColumns({BLOCK: F.lit(0).cast("long"), CARRIED: F.lit(False), POSITION: position})
    same = None
    for key in keys:
        one = df[key].eqNullSafe(long[key])
        same = one if same is None else same & one
    rest = df.join(F.broadcast(long), same, "left_anti")
    whole = rest.withColumns({BLOCK: F.lit(0).cast("long"), CARRIED: F.lit(False), POSITION: position})
    return whole.unionByName(cut(df.join(F.broadcast(long), same, "left_semi"), keys, order, lookback, align, block_rows))


def cut(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    lookback: int,
    align: int = 1,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Every series in blocks of `block_rows` rows, rounded up to a multiple of `align`.

    The last `lookback` rows of a block also travel, marked `_carried`, into the
    next one. Cuts lie at the same positions of a key however the rows are spread.

    The numbers come from one range partitioning by key and order, written once:
    a partition's rows are numbered as they lie, and one row for each key and
    partition says how many rows of the key lie before. No task holds a whole
    key, and NULL keys and order values are values like others.
    """
    size = -(-max(block_rows, lookback + 1) // align) * align
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    numbered = written_once(ranged.withColumn("_row", F.monotonically_increasing_id()), "series")
    part = F.shiftright("_row", 33)  # the partition is the upper part of such a number
    names = {key: f"_key{i}" for i, key in enumerate(keys)}
    runs = numbered.groupBy(*[F.col(key).alias(name) for key, name in names.items()], part.alias("_run")).agg(
        F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    before = Window.partitionBy(*names.values()).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(
        *names.values(), "_run", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift")
    )
    same = part == F.col("_run")
    for key, name in names.items():
        same = same & numbered[key].eqNullSafe(starts[name])
    placed = numbered.join(starts, same).withColumn(POSITION, F.col("_row") + F.col("_shift") + 1)
    own = F.floor((F.col(POSITION) - 1) / size).cast("long")
    travels = F.col(POSITION) > (own + 1) * size - lookback
    blocks = F.explode(F.when(travels, F.array(own, own + 1)).otherwise(F.array(own)))
    return (
        placed.withColumn(BLOCK, blocks)
        .withColumn(CARRIED, F.col(BLOCK) != own)
        .drop("_row", "_run", "_shift", *names.values())
    )


def drop_carried(df: DataFrame) -> DataFrame:
    return df.filter(~F.col(CARRIED)).drop(BLOCK, CARRIED, POSITION)


def price_change(
    df: DataFrame,
    key: str,
    price: str,
    order: Sequence[str],
    digits: int = 2,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Change against the key's previous price, absolute and in percent.

    The first price of a key has no previous one: both are 0.
    """
    last = F.lag(price).over(Window.partitionBy(key, BLOCK).orderBy(*order))
    blocks = in_blocks(df, [key], order, 1, block_rows=block_rows).withColumn("_last", last)
    moved = F.col(price) - F.col("_last")
    percent = F.try_divide(100 * moved, F.col("_last"))
    return drop_carried(
        blocks.withColumns(
            {
                "price_change": F.coalesce(F.round(moved, digits), F.lit(0.0)),
                "price_change_percent": F.coalesce(F.round(percent, digits), F.lit(0.0)),
            }
        )
    ).drop("_last")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key along `order`.

    An aggregate, not a window: each task sorts its rows by key and reduces them
    to one per key before the shuffle, whatever the size of the key.
    """
    keys = list(keys)
    rest = [name for name in df.columns if name not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_newest")
    rows = df.groupBy(*keys).agg(newest).select(*keys, "_newest.*")
    return rows.select(*df.columns)
