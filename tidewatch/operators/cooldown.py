"""Alert cooldown: per key, send the first alert and then the first one at
least the cooldown after the last *sent* one.

Whether an alert is sent depends on the last sent one, so a key is a chain. The rows
of a key pass by in order, an Arrow batch in hand at a time, and one number goes from
batch to batch: the time from which the key may send again. Keys with more rows than a
shuffle partition's share are not left to one task. Their alerts are put in order by
one range partitioning and cut into chunks of `CHUNK_ROWS` rows, whatever their times.
The part of a key in a chunk is a step function: from the time from which the key may
send when the chunk begins to that time when it ends.

1. each chunk states the functions of its first and last key; no other key crosses
   its edges;
2. the functions of a key are composed pairwise, level by level, in a tree, and the
   times are pushed down from its root: after as many rounds as the tree is high
   every chunk knows its own;
3. each chunk follows its chains from there.

A function has a step for every time in the chunk at which a chain may begin: those
in its first cooldown. A task holds one chunk, or the steps of two neighbours.
"""

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch import constants as K
from tidewatch.operators.series import long_keys
from tidewatch.session import ship_package, written_once

CHUNK_ROWS = 1 << 14
NEVER = -(2**62)


def alert_key(source="source", entity="id") -> Column:
    """Alerts share a cooldown by source and entity."""
    unknown = F.lit(K.MISSING_TEXT)
    return F.concat(
        F.coalesce(F.col(source).cast("string"), unknown),
        F.lit(":"),
        F.coalesce(F.col(entity).cast("string"), unknown),
    )


def _whole_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Regroup sorted batches so that every table is one chunk."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        chunk = table.column("_chunk").to_numpy()
        if held and held[0].column("_chunk")[0].as_py() != chunk[0]:
            yield pa.concat_tables(held)
            held = []
        cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
        for start, end in zip(cuts[:-2], cuts[1:-1]):
            yield pa.concat_tables([*held, table.slice(start, end - start)])
            held = []
        held.append(table.slice(cuts[-2]))
    if held:
        yield pa.concat_tables(held)


def _chains(table: pa.Table, gap: int):
    """Where each key begins, the number of its part, its times, and every row's next send.

    One axis has all parts: steps of more than a cooldown count as one, so it is short,
    and one search over it finds all successors. A row without one is its own.
    """
    time = table.column("_time").to_numpy()
    new = np.ones(len(time), bool)
    key = table.column("_key").combine_chunks()
    new[1:] = pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False)
    part = np.cumsum(new) - 1
    step = np.full(len(time), gap, np.int64)
    step[1:] = np.where(new[1:], gap, np.minimum(np.diff(time), gap))
    axis = np.cumsum(step)
    following = np.searchsorted(axis, axis + gap, side="left")
    inside = following < len(axis)
    inside[inside] = part[following[inside]] == part[inside]
    return new, part, time, step, np.where(inside, following, np.arange(len(axis)))


def _steps(gap: int):
    """The functions of each chunk's first and last key: `_time` up to which a start leads to `_out`."""

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_chunks(batches):
            new, part, time, _, following = _chains(table, gap)
            end = following
            while not np.array_equal(end, end[end]):
                end = end[end]
            first = np.flatnonzero(new)
            entered = time[first][part]
            start = time - entered < gap
            start[1:] |= start[:-1] & ~new[1:]  # and the first one after
            start &= (part == 0) | (part == part[-1])
            at = np.flatnonzero(start)
            out = time[end[at]] + gap
            last = np.ones(len(at), bool)  # of neighbours that lead to the same only the last matters
            last[:-1] = (out[1:] != out[:-1]) | (part[at][1:] != part[at][:-1])
            kept = table.select(["_key", "_chunk", "_time"]).take(pa.array(at[last]))
            yield from kept.append_column("_out", pa.array(out[last])).to_batches()

    return steps


def _composed(functions: DataFrame, gap: int) -> DataFrame:
    """Functions of neighbouring nodes as one: `_key`, `_node`, `_time`, `_out`.

    What leaves the first node is looked up among the steps of the second. A time after
    all steps of the first goes to the second as it is; such times matter only within
    a cooldown of the first step.
    """
    left = F.col("_node") % 2 == 0
    pair = functions.select(
        "_key", F.shiftright("_node", 1).alias("_node"), left.alias("_left"), "_time", "_out",
        F.when(left, F.col("_out")).otherwise(F.col("_time")).alias("_place"),
    )
    node = Window.partitionBy("_key", "_node")
    later = node.orderBy(F.desc("_place"), "_left").rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(F.col("_left"), F.col("_time"))
    looked = pair.select(
        "*",
        F.last(F.when(~F.col("_left"), F.col("_out")), ignorenulls=True).over(later).alias("_found"),
        F.min(own).over(node).alias("_first"),
        F.max(own).over(node).alias("_last"),
    )
    tail = (F.col("_time") > F.col("_last")) & (F.col("_last") - F.col("_first") < gap)
    return looked.where(F.col("_left") | tail).select(
        "_key", "_node", "_time", F.when(F.col("_left"), F.coalesce("_found", "_out")).otherwise(F.col("_out")).alias("_out")
    )


def _pushed_down(entered: DataFrame, functions: DataFrame) -> DataFrame:
    """From the times at which nodes are entered to those of their two children."""
    first = functions.where("_node % 2 = 0").withColumn("_node", F.shiftright("_node", 1))
    leads = (
        entered.join(first, ["_key", "_node"], "left")
        .groupBy("_key", "_node", "_free")
        .agg(F.min(F.when(F.col("_time") >= F.col("_free"), F.struct("_time", "_out"))).alias("_step"))
    )
    children = F.array(
        F.struct((2 * F.col("_node")).alias("_node"), F.col("_free").alias("_free")),
        F.struct((2 * F.col("_node") + 1).alias("_node"), F.coalesce("_step._out", "_free").alias("_free")),
    )
    return leads.select("_key", F.explode(children).alias("_child")).select("_key", "_child.*")


def _open_times(steps: DataFrame, gap: int) -> DataFrame:
    """`_chunk`, `_key`, `_free`: when the first key of a chunk may send again, where it began before."""
    steps = written_once(steps, "cooldown-steps")
    chunks = steps.groupBy("_key", "_chunk").agg(F.min("_time").alias("_begin"))
    number = F.row_number().over(Window.partitionBy("_key").orderBy("_chunk")).cast("long") - 1
    # one row for a chunk: what a key has of these is a small part of its rows
    nodes = chunks.select("_key", "_chunk", number.alias("_node"), F.count(F.lit(1)).over(Window.partitionBy("_key")).alias("_of"))
    nodes = nodes.where("_of > 1")
    longest = nodes.agg(F.max("_of")).first()[0] or 0
    if not longest:
        return nodes.select("_chunk", "_key", F.lit(NEVER).cast("long").alias("_free")).limit(0)
    levels = [steps.join(nodes, ["_key", "_chunk"]).select("_key", "_node", "_time", "_out")]
    while longest > 2:
        if len(levels) == 1:
            levels[0] = written_once(levels[0], "cooldown-level")
        levels.append(written_once(_composed(levels[-1], gap), "cooldown-level"))
        longest = (longest + 1) // 2
    times = nodes.where("_node = 0").select("_key", "_node", F.lit(NEVER).cast("long").alias("_free"))
    for functions in reversed(levels):
        times = _pushed_down(times, functions)
    return times.where(F.col("_free") > NEVER).join(nodes, ["_key", "_node"]).select("_chunk", "_key", "_free")


def _sent(timed: pa.Table, gap: int, free: int | None):
    """Which rows are sent, if the first key may send from `free` on, and from when the last one may."""
    new, part, time, step, following = _chains(timed, gap)
    start = step >= gap  # so long after the one before that it is sent whatever came before
    if free is not None:
        size = int(np.searchsorted(part, 0, side="right"))
        at = int(np.searchsorted(time[:size], free, side="left"))
        start[:at] = False
        if at < size:
            start[at] = True
    sent = np.zeros(len(time), bool)
    at = np.flatnonzero(start)
    while len(at):
        sent[at] = True
        at = following[at]
        at = at[~sent[at]]
    last = np.flatnonzero(sent & (part == part[-1]))
    return sent, int(time[last[-1]]) + gap if len(last) else free


def _rows(kept: pa.ChunkedArray, columns: Sequence[str]) -> Iterator[pa.RecordBatch]:
    for chunk in kept.chunks:
        if len(chunk):
            yield pa.RecordBatch.from_arrays(chunk.flatten(), names=list(columns))


def _follow_keys(gap: int, columns: Sequence[str]):
    """The rows, kept whole in `_row`, that are sent; keys come whole, one after the other."""

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = free = None
        for batch in batches:
            alerts = pa.Table.from_batches([batch])
            untimed = alerts.column("_time").is_null()
            yield from _rows(alerts.filter(untimed).column("_row"), columns)
            timed = alerts.filter(pc.invert(untimed))
            if timed.num_rows:
                names = timed.column("_key")
                sent, free = _sent(timed, gap, free if names[0] == key else None)
                key = names[-1]
                yield from _rows(timed.column("_row").take(pa.array(np.flatnonzero(sent))), columns)

    return follow


def _follow_chunks(gap: int, columns: Sequence[str]):
    """The rows, kept whole in `_row`, that are sent; a row ahead of a chunk says when its first key may send."""

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_chunks(batches):
            opens = table.filter(table.column("_free").is_valid())
            alerts = table.filter(table.column("_free").is_null())
            untimed = alerts.column("_time").is_null()
            yield from _rows(alerts.filter(untimed).column("_row"), columns)
            timed = alerts.filter(pc.invert(untimed))
            if timed.num_rows:
                goes_on = opens.num_rows and opens.column("_key")[0] == timed.column("_key")[0]
                sent, _ = _sent(timed, gap, opens.column("_free")[0].as_py() if goes_on else None)
                yield from _rows(timed.column("_row").take(pa.array(np.flatnonzero(sent))), columns)

    return follow


def _in_chunks(keyed: DataFrame, place: Sequence[str], gap: int, chunk_rows: int, alerts: DataFrame) -> DataFrame:
    """What is sent of keys of any length."""
    laid = keyed.repartitionByRange(*place).sortWithinPartitions(*place)
    laid = laid.select("_key", "_time", F.monotonically_increasing_id().alias("_at"), "_row")
    laid = written_once(laid, "cooldown-alerts")
    partition = F.shiftright("_at", 33)  # the upper part of such a number; the lower one counts rows
    within = F.expr(f"(_at & 8589934591) DIV {int(chunk_rows)}")
    laid = laid.withColumn("_chunk", F.shiftleft(partition, 33) + within)
    steps = (
        laid.where("_time IS NOT NULL")
        .select("_key", "_time", "_at", "_chunk")
        .repartition("_chunk")
        .sortWithinPartitions("_chunk", "_at")
        .mapInArrow(_steps(gap), "_key string, _chunk long, _time long, _out long")
    )
    opens = _open_times(steps, gap).withColumn("_at", F.lit(-1).cast("long"))
    return (
        laid.unionByName(opens, allowMissingColumns=True)
        .repartition("_chunk")
        .sortWithinPartitions("_chunk", "_at")
        .mapInArrow(_follow_chunks(gap, alerts.columns), alerts.schema)
    )


def cooldown(
    alerts: DataFrame,
    key: str,
    order: Sequence[str],
    minutes: float = K.COOLDOWN_MINUTES,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """The alerts that are sent. `order` starts with the event time and tells
    all alerts of a key apart. An alert without an event time has no place in
    the chain: it is sent, and holds up no other."""
    gap = int(minutes * 60_000_000)
    if gap <= 0:
        return alerts
    ship_package(alerts.sparkSession)
    ranks = [f"_rank{i}" for i in range(1, len(order))]
    place = ["_key", "_time", *ranks]
    keyed = alerts.select(
        F.coalesce(F.col(key).cast("string"), F.lit(K.MISSING_TEXT)).alias("_key"),
        F.unix_micros(F.col(order[0]).cast("timestamp")).alias("_time"),
        *[F.col(name).alias(rank) for name, rank in zip(order[1:], ranks)],
        F.struct(*[F.col(f"`{name}`") for name in alerts.columns]).alias("_row"),
    )
    long = long_keys(keyed, ["_key"], chunk_rows)
    rest = keyed if long is None else keyed.join(F.broadcast(long), "_key", "left_anti")
    whole = (
        rest.repartition("_key")
        .sortWithinPartitions(*place)
        .select("_key", "_time", "_row")
        .mapInArrow(_follow_keys(gap, alerts.columns), alerts.schema)
    )
    if long is None:
        return whole
    return whole.unionByName(_in_chunks(keyed.join(F.broadcast(long), "_key", "left_semi"), place, gap, chunk_rows, alerts))
