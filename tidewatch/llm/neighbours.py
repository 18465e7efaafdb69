"""Nearest neighbours by largest inner product, along shifted space-filling curves.

Vectors are put in levels by length, each up to twice as long as the next, so that
in a level the direction says most about the inner product and a few long vectors
change nothing for the others. Rows and queries are scaled to length one. Several
times, each time turned another way and shifted, a few of the turned components,
less their mean, give every vector a place on a Hilbert curve. One range partitioning
by Spark puts the rows of every level and curve in order and numbers them. A query
meets, in every level and on each curve, the rows up to `reach` numbers before and
after it; what it meets on any of them is merged and ranked by exact inner products.

How many of the curves are used and how far a query reaches is set by the data, in
rows: some queries are compared with all rows, and of the numbers of curves, each
with the least reach that finds `FOUND` of their nearest, the one is taken that
compares the fewest rows. Where vectors have no structure that may be all of them, along one curve.

Equal vectors are one to the index. The numbered rows are dealt out in ranges of `ROWS`
rows, whatever the size of the table, with the queries that reach into them; no
bounds of ranges are held anywhere.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.tables import map_batches
from tidewatch.session import ship_package, written_once

CURVES, COMPONENTS, BITS = 16, 4, 15  # at most so many curves
LEVELS = 16  # by length; the last one has all that are shorter
ROWS = 4096  # rows of a range: what a task holds at once
STEP = 128  # queries whose numbers lie so close, or closer than they reach, are compared together
FOUND, TRIED = 0.93, 256  # the share of the nearest that the reach finds, and the queries it is set by
TOGETHER = 256  # queries compared at once
PAIRS = 65_536  # pairs whose inner products are summed at once
FIT = 4096  # vectors, about, that the scale of the curves is fitted on


def hilbert_keys(places: np.ndarray, bits: int) -> np.ndarray:
    """Positions along a Hilbert curve of points with integer coordinates below 2^bits.

    From the coordinates' bits, high to low, reflections and exchanges are
    undone; what is left, read across, is the position in Gray code.
    """
    x = places.T.astype(np.int64)
    axes = len(x)
    for bit in range(bits - 1, 0, -1):
        high, low = 1 << bit, (1 << bit) - 1
        for axis in range(axes):
            set_here = (x[axis] & high) != 0
            exchange = np.where(set_here, 0, (x[0] ^ x[axis]) & low)
            x[0] ^= np.where(set_here, low, exchange)
            x[axis] ^= exchange
    for axis in range(1, axes):
        x[axis] ^= x[axis - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for axis in range(axes):
            key = key << 1 | (x[axis] >> bit) & 1
    return key


class Curves:
    """Random turns and shifts, the same for the same numbers, and the middle and scale of the components."""

    def __init__(self, fit: np.ndarray):
        draw = np.random.default_rng(11)
        size = fit.shape[1]
        turns = [np.linalg.qr(draw.normal(size=(size, size)))[0] for _ in range(-(-CURVES * COMPONENTS // size))]
        self.turn = np.concatenate(turns, axis=1)[:, : CURVES * COMPONENTS]
        self.shift = draw.random(self.turn.shape[1])
        found = self.turned(fit)
        self.middle, self.spread = found.mean(axis=0), np.maximum(found.std(axis=0), 1e-9)

    def turned(self, vectors: np.ndarray) -> np.ndarray:
        scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
        return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None] @ self.turn

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """The place of each vector (row) on each curve (column)."""
        unit = ((self.turned(vectors) - self.middle) / (6 * self.spread) + 0.5) / 2 + self.shift / 2
        places = np.clip((unit * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
        return np.stack([hilbert_keys(places[:, k::CURVES], BITS) for k in range(CURVES)], axis=1)


def matrix(batch: pa.RecordBatch, column: str, dimensions: int, kind: type = float) -> np.ndarray:
    return np.asarray(batch.column(column).flatten(), kind).reshape(-1, dimensions)


def summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, added up component by component: the same for a pair wherever it is met."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def best_of(queries: np.ndarray, rows: np.ndarray, numbers: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query the `wanted` rows with the largest inner products, ties by the smaller number: query, row, score.

    Rows whose rough product may equal the last one wanted but for rounding are
    all summed exactly before it is decided which of them stay.
    """
    rough = queries @ rows.T
    few = min(len(rows), wanted)
    cut = np.partition(rough, len(rows) - few, axis=1)[:, len(rows) - few]
    rounding = 4 * rows.shape[1] * np.finfo(float).eps * np.linalg.norm(queries, axis=1) * np.linalg.norm(rows, axis=1).max()
    query, row = np.nonzero(rough >= (cut - rounding)[:, None])
    pieces = [slice(at, at + PAIRS) for at in range(0, len(query), PAIRS)]
    score = np.concatenate([summed(queries[query[piece]], rows[row[piece]]) for piece in pieces])
    order = np.lexsort((numbers[row], -score, query))
    query, row, score = query[order], row[order], score[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < wanted
    return query[keep], row[keep], score[keep]


def numbered(items: DataFrame) -> DataFrame:
    """`curve`, `level`, `class`, `asks`, `at`: how many rows come before each point of a curve and level.

    Points are rows (`asks` 0) and queries (1); a query comes after the row that it is itself. One range
    partitioning orders them, tasks count what they hold, and the counts of whole tasks are added.
    """
    order = ["curve", "level", "key", "class", "asks"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, carried = TaskContext.get().partitionId(), -1, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            group = np.asarray(batch.column("curve")) * LEVELS + np.asarray(batch.column("level"))
            rows = 1 - np.asarray(batch.column("asks"))
            before = np.cumsum(rows) - rows
            first = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1])
            lengths = np.diff(np.append(first, len(group)))
            local = before - np.repeat(before[first], lengths) + np.where(group == last, carried, 0)
            last, carried = group[-1], local[-1] + rows[-1]
            columns = [*(batch.column(name) for name in ("curve", "level", "class", "asks")), pa.array(local, pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(np.full(len(group), part), pa.int32())], ["curve", "level", "class", "asks", "local", "part"]
            )

    sorted_items = items.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    schema = "curve int, level int, class long, asks int, local long, part int"
    counted = written_once(sorted_items.mapInArrow(count, schema), "neighbours-places")
    earlier = Window.partitionBy("curve", "level").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counted.groupBy("curve", "level", "part").agg(F.sum(1 - F.col("asks")).alias("n"))
    starts = parts.select("curve", "level", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    return counted.join(starts, ["curve", "level", "part"]).select(
        "curve", "level", "class", "asks", (F.col("local") + F.col("start")).alias("at")
    )


def exact_nearest(rows: DataFrame, tried: list, dimensions: int, nearest: int) -> list[tuple[int, int]]:
    """(query class, row class) of the true nearest of a few queries, which are compared with all rows."""
    asked, names = np.array([row["vector"] for row in tried], float), np.array([row["class"] for row in tried])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, int), np.zeros(0, int), np.zeros(0)]
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers = np.asarray(batch.column("class"))
            query, row, score = best_of(asked, matrix(batch, "vector", dimensions), numbers, nearest + 1)
            kept = [np.concatenate(x) for x in zip(kept, (query, numbers[row], score), strict=True)]
            order = np.lexsort((kept[1], -kept[2], kept[0]))
            kept = [x[order] for x in kept]
            first = np.arange(len(order)) - np.searchsorted(kept[0], kept[0]) <= nearest
            kept = [x[first] for x in kept]
        other = kept[1] != names[kept[0]]
        yield pa.RecordBatch.from_arrays([pa.array(x[other]) for x in kept], ["query", "class", "score"])

    found = rows.select("class", "vector").mapInArrow(compared, "query long, class long, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "class")
    best = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= nearest)
    return [(int(names[row["query"]]), row["class"]) for row in best.select("query", "class").collect()]


def reach_of(pairs: list[tuple[int, int]], places: DataFrame, sizes: dict[int, int], nearest: int) -> tuple[int, int]:
    """How many curves to use and how far to reach, by the places of pairs that should be found.

    The pairs are bounded by `TRIED` and `nearest`; the places of these alone come to the driver.
    """
    least = nearest + 1  # so that every query meets enough rows to answer
    if not pairs:
        return 1, least
    wanted = [(int(x), 1) for x in {query for query, _ in pairs}] + [(int(x), 0) for x in {row for _, row in pairs}]
    spark = places.sparkSession
    known = F.broadcast(spark.createDataFrame(wanted, "class long, asks int"))
    points: dict[int, tuple[int, dict[int, int]]] = {}
    probes: dict[tuple[int, int], dict[int, int]] = {}
    for row in places.join(known, ["class", "asks"]).collect():
        if row["asks"]:
            probes.setdefault((row["class"], row["level"]), {})[row["curve"]] = row["at"]
        else:
            points.setdefault(row["class"], (row["level"], {}))[1][row["curve"]] = row["at"]
    away = np.zeros((len(pairs), CURVES), np.int64)
    for i, (query, row) in enumerate(pairs):
        level, at = points[row]
        probe = probes[query, level]
        away[i] = [probe[k] - at[k] if at[k] < probe[k] else at[k] - probe[k] + 1 for k in range(CURVES)]
    nearer = np.sort(np.minimum.accumulate(away, axis=1), axis=0)
    reaches = np.maximum(nearer[int(np.ceil(FOUND * len(pairs))) - 1], least)
    met = [sum(min(n, 2 * int(reach) + max(int(reach), STEP) // 2) for n in sizes.values()) for reach in reaches]
    curves = int(np.argmin(np.arange(1, CURVES + 1) * met)) + 1
    return curves, int(reaches[curves - 1])


def windows(at: np.ndarray, start: int, size: int, reach: int) -> Iterator[tuple[int, int, int, int]]:
    """For the sorted numbers of queries: runs of them, and the rows of a range of `size` rows from `start` that each run meets."""
    first = 0
    while first < len(at):
        last = min(int(np.searchsorted(at, at[first] + max(reach, STEP))), first + TOGETHER)
        low, high = max(0, at[first] - reach - start), min(size, at[last - 1] + reach - start)
        if low < high:
            yield first, last, int(low), int(high)
        first = last


def search(
    vectors: DataFrame, asked: Column, key: str = "vec_id", vector: str = "embedding", nearest: int = 20
) -> DataFrame:
    """`query_id`, `rank`, `vec_id`, `score`: for each row where `asked` holds the nearest other rows found.

    `asked` is a condition on `vec_id`. Scores are inner products in double
    precision, largest first, ties by the smaller id; all other rows if there are
    fewer. Vectors that are null, zero, or hold a null or a number that is not
    finite take no part, nor do null ids and vectors of another length than most
    have. Rows with the same id and vector are one. An empty table gives no rows.
    Other columns are ignored.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    kind = vectors.schema[key].dataType.simpleString()
    stored = "array<float>" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    valid = (
        vectors.select(F.col(key).alias("vec_id"), F.col(vector).cast(stored).alias("vector"))
        .where(F.col("vec_id").isNotNull())
        .where(usable(F.col("vector")))
        .withColumn("asked", asked)
    )
    dimensions = valid.agg(F.mode(F.size("vector"), True)).first()[0]
    if not dimensions:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    valid = valid.where(F.size("vector") == dimensions)

    # Equal vectors: one class, its smallest ids (one more than asked for), and whether any of it asks.
    first = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    some = valid.distinct().withColumn("n", first).where(F.col("n") <= nearest + 1)
    flags = valid.groupBy("vector").agg(F.bool_or("asked").alias("asks"))
    grouped = some.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).join(flags, "vector")
    # Classes are numbered by their first ids, so tasks that know the number alone settle ties as the ids do.
    ordered = grouped.orderBy(F.get("ids", F.lit(0))).withColumn("class", F.monotonically_increasing_id())
    classes = written_once(ordered, "neighbours-classes")

    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    stats = classes.agg(F.count("*").alias("n"), F.max(square).alias("longest")).first()
    bound = min((1 << 63) - 1, (FIT << 64) // stats["n"] - (1 << 63))  # hashes of all 64 bits, so no share is too small
    fit = classes.where(F.xxhash64("class") <= bound).select("vector").collect()
    curves = Curves(np.array([row["vector"] for row in fit or classes.limit(1).select("vector").collect()], float))

    def placed(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = curves.keys(matrix(batch, "vector", dimensions))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(found), pa.list_(pa.int64()))], [*batch.schema.names, "keys"])

    shorter = F.log2(F.lit(stats["longest"]) / square) / 2
    level = F.least(F.lit(LEVELS - 1), F.greatest(F.lit(0), F.floor(shorter))).cast("int")
    levelled = classes.select("class", "vector", "asks", level.alias("level"))
    schema = f"class long, vector {stored}, asks boolean, level int, keys array<long>"
    rows = written_once(map_batches(levelled, placed, schema), "neighbours-keys")
    queries = rows.where("asks")

    sizes = {row["level"]: row["n"] for row in rows.groupBy("level").agg(F.count("*").alias("n")).collect()}
    key_of_curve = F.posexplode("keys").alias("curve", "key")
    points = rows.select("level", "class", F.lit(0).alias("asks"), key_of_curve)
    every = F.explode(F.array(*map(F.lit, sizes))).alias("level")
    probes = queries.select("class", "keys", every).select("level", "class", F.lit(1).alias("asks"), key_of_curve)
    places = numbered(points.unionByName(probes))
    tried = queries.orderBy(F.xxhash64("class"), "class").limit(TRIED).select("class", "vector").collect()
    pairs = exact_nearest(rows, tried, dimensions, nearest) if tried else []
    used, reach = reach_of(pairs, places, sizes, nearest)

    # Rows go to the range that their number lies in, queries to all that they reach into.
    end = F.element_at(F.create_map(*(F.lit(x) for item in sizes.items() for x in item)), F.col("level"))
    reached = F.sequence(
        F.floor(F.greatest(F.col("at") - reach, F.lit(0)) / ROWS), F.floor((F.least(F.col("at") + reach, end) - 1) / ROWS)
    )
    own = F.array(F.floor(F.col("at") / ROWS))
    lots = places.where(F.col("curve") < used).select(
        "class", "curve", "level", "asks", "at", F.explode(F.when(F.col("asks") == 0, own).otherwise(reached)).alias("range")
    )
    lot = ["curve", "level", "range"]
    dealt = lots.join(rows.select("class", "vector"), "class").repartition(*lot).sortWithinPartitions(*lot, "asks", "at")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, ids, table, numbers = None, [], [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([np.asarray(batch.column(name)) for name in (*lot, "asks")])
            edges = np.flatnonzero(np.any(np.diff(keys, axis=0) != 0, axis=1)) + 1
            for start, stop in zip([0, *edges], [*edges, len(keys)], strict=True):
                part = batch.slice(start, stop - start)
                name, asks = tuple(keys[start, :3]), keys[start, 3]
                data, classed = matrix(part, "vector", dimensions), np.asarray(part.column("class"))
                if name != current:
                    current, held, ids, table = name, [], [], None
                if not asks:
                    held.append(data)
                    ids.append(classed)
                    continue
                if table is None:
                    table, numbers = np.concatenate(held), np.concatenate(ids)
                for first, last, low, high in windows(np.asarray(part.column("at")), name[2] * ROWS, len(table), reach):
                    query, row, score = best_of(data[first:last], table[low:high], numbers[low:high], nearest + 1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(classed[first:last][query]), pa.array(numbers[low:high][row]), pa.array(score)],
                        ["query", "class", "score"],
                    )

    met = dealt.select(*lot, "asks", "at", "class", "vector").mapInArrow(meet, "query long, class long, score double")
    met = met.groupBy("query", "class").agg(F.max("score").alias("score"))
    members = classes.select("class", "ids")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "class")
    best = (
        met.join(members, "class")
        .withColumn("n", F.row_number().over(order))
        .where(F.col("n") <= nearest + 1)
        .groupBy("query")
        .agg(F.collect_list(F.struct("score", "ids")).alias("found"))
    )
    # Each asking row of a class takes the class's list, without itself.
    asking = valid.where("asked").select("vec_id", "vector").distinct()
    each = asking.join(classes.select("vector", F.col("class").alias("query")), "vector").select(
        F.col("vec_id").alias("query_id"), "query"
    )
    listed = F.flatten(
        F.transform("found", lambda x: F.transform(x["ids"], lambda i: F.struct((-x["score"]).alias("down"), i.alias("vec_id"))))
    )
    others = F.filter(F.array_sort(listed), lambda x: x["vec_id"] != F.col("query_id"))
    return (
        each.join(best, "query")
        .select("query_id", F.posexplode(F.slice(others, 1, nearest)).alias("place", "x"))
        .select(
            "query_id", (F.col("place") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.down")).alias("score")
        )
    )
