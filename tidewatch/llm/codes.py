"""Vectors as short codes: one byte for each part, the index of the nearest codebook entry.

The nearest entry is found by equal-average search. The entries of a part's codebook
are sorted by the sum of their components; a search starts at the sum of the part and
goes outward, the nearer sum first. By the inequality of means an entry whose sum
is g away is at least g * g / dimension away itself, so a search ends where that
strictly exceeds the best distance; entries that may tie are still looked at. All
numbers are integers, so nothing is rounded.

Codebooks are improved round by round: tasks add up the parts of each entry, Spark
adds up the tasks' sums, and the driver holds the codebooks alone.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.groups import look_up
from tidewatch.llm.tables import map_batches
from tidewatch.session import ship_package, written_once

SCALE = 256
PORTION = 1 << 20  # components in a task's hands at once
LIMIT = 1 << 62


def usable(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """`key`, `label`, `vector` (doubles) of the rows whose vector has only finite components."""
    rows = vectors.select(
        F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector")
    )
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vector").isNotNull() & finite)


def integers(vectors: np.ndarray, parts: int) -> np.ndarray:
    """Floors of the scaled components, as (row, part, component)."""
    size = vectors.shape[1] // parts
    scaled = np.floor(SCALE * vectors)
    # twice a component, squared, times the components of a vector or a part's squared, fits in a long
    if scaled.size and 4 * float(np.abs(scaled).max()) ** 2 * max(size * size, vectors.shape[1]) >= LIMIT:
        raise ValueError("components are too large: squared distances would not fit in 64 bits")
    return scaled.astype(np.int64).reshape(len(vectors), parts, size)


def nearest(items: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry, ties to the lower index, as (row, part)."""
    rows, parts, size = items.shape
    entries = books.shape[1]
    sums = books.sum(axis=2)
    order = np.argsort(sums, axis=1, kind="stable")
    sums = np.take_along_axis(sums, order, axis=1)
    own = items.sum(axis=2)
    right = np.stack([np.searchsorted(sums[p], own[:, p]) for p in range(parts)], axis=1).ravel()
    part = np.tile(np.arange(parts), rows)
    own, flat, left = own.ravel(), items.reshape(-1, size), right - 1
    best = np.full(rows * parts, LIMIT // max(size, 1))
    index = np.full(rows * parts, entries)
    active, none = np.arange(rows * parts), np.int64(1) << 31
    while len(active):
        p, low, high = part[active], left[active], right[active]
        below = np.where(low >= 0, own[active] - sums[p, np.maximum(low, 0)], none)
        above = np.where(high < entries, sums[p, np.minimum(high, entries - 1)] - own[active], none)
        gap = np.minimum(below, above)
        going = (gap < none) & ~(gap * gap > best[active] * size)
        active, p, low, high, down = active[going], p[going], low[going], high[going], (below <= above)[going]
        entry = order[p, np.where(down, low, high)]
        apart = flat[active] - books[p, entry]
        distance = np.einsum("ij,ij->i", apart, apart)
        better = (distance < best[active]) | ((distance == best[active]) & (entry < index[active]))
        best[active[better]], index[active[better]] = distance[better], entry[better]
        left[active[down]] -= 1
        right[active[~down]] += 1
    return index.reshape(rows, parts), best.reshape(rows, parts)


def _matrices(batch: pa.RecordBatch, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """The vectors of a batch in portions, each with the number of its first row."""
    flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, length)
    step = max(1, PORTION // max(length, 1))
    for start in range(0, batch.num_rows, step):
        yield start, flat[start : start + step]


def _improved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry becomes the floor of the mean of its parts; entries without parts stay."""
    parts, entries, size = books.shape
    ship_package(rows.sparkSession)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = np.zeros((parts * entries, size), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            if batch.num_rows:
                for _, some in _matrices(batch, parts * size):
                    items = integers(some, parts)
                    place = (nearest(items, books)[0] + np.arange(parts) * entries).ravel()
                    np.add.at(totals, place, items.reshape(-1, size))
                    counts += np.bincount(place, minlength=parts * entries)
        used = np.flatnonzero(counts)
        if len(used):
            place, column = np.repeat(used, size), np.tile(np.arange(size), len(used))
            yield pa.RecordBatch.from_arrays(
                [pa.array(place), pa.array(column), pa.array(np.repeat(counts[used], size)), pa.array(totals[used].ravel())],
                ["place", "component", "n", "total"],
            )

    sums = rows.select("vector").mapInArrow(add_up, "place long, component long, n long, total long")
    exact = [F.sum(F.col(name).cast("decimal(20,0)")).alias(name) for name in ("n", "total")]
    better = books.copy().reshape(-1, size)
    for row in sums.groupBy("place", "component").agg(*exact).collect():  # one for each component of the codebooks
        better[row.place, row.component] = int(row.total) // int(row.n)
    return better.reshape(books.shape)


def learn(rows: DataFrame, parts: int, entries: int, rounds: int) -> np.ndarray | None:
    """Codebooks as (part, entry, component); none if no vector can be cut into parts.

    They start as the parts of the rows with the smallest keys (ties by the vector, null
    keys last) whose vectors can be cut; the first of these sets the length of all.
    """
    cut = rows.where((F.size("vector") > 0) & (F.size("vector") % parts == 0))
    order = [F.asc_nulls_last("key"), "vector"]
    first = cut.orderBy(*order).select("vector").first()
    if first is None:
        return None
    same = cut.where(F.size("vector") == len(first.vector))
    start = same.orderBy(*order).limit(entries).select("vector").collect()
    books = integers(np.array([row.vector for row in start]), parts).transpose(1, 0, 2)
    for _ in range(rounds):
        books = _improved(same, books)
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """`key`, `label`, `code` (two hex digits a part) and `error` of every vector of the codebooks' length."""
    parts, _, size = books.shape
    same = rows.where(F.size("vector") == parts * size)

    def of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes, errors = [], []
        for _, some in _matrices(batch, parts * size):
            index, distance = nearest(integers(some, parts), books)
            codes += [row.tobytes().hex() for row in index.astype(np.uint8)]
            errors.append(distance.sum(axis=1))
        columns = [batch.column("key"), batch.column("label"), pa.array(codes, pa.string()), pa.array(np.concatenate(errors))]
        return pa.RecordBatch.from_arrays(columns, ["key", "label", "code", "error"])

    kinds = dict(rows.dtypes)
    return map_batches(same, of_batch, f"key {kinds['key']}, label {kinds['label']}, code string, error long")


def digest(books: np.ndarray | None) -> str:
    """SHA-256 of all components, decimal and comma-joined, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist() if books is not None else [])).encode()).hexdigest()


def compress(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
) -> DataFrame:
    """For every usable vector: `key`, `code`, `error`, `label_error`, `codebooks_sha256`.

    `error` is the squared distance, in scaled integers, between the vector and what its
    code stands for; `label_error` adds it up over all rows of the label, null
    labels being one label. Rows whose vector is null, holds null, NaN or infinity, or has
    not the length of the codebooks (`learn`) have no code and do not come out. There
    may be fewer entries than asked for, if there are fewer rows. Repeated rows come out
    as often as they go in; null keys are coded like others. Components so large that
    squared distances do not fit in 64 bits are an error. Other columns are ignored.
    """
    if not 0 < entries <= 256:
        raise ValueError("an index has two hex digits: 1 to 256 entries")
    rows = usable(vectors, key, vector, label)
    books = learn(rows, parts, entries, rounds)
    if books is None:
        books = np.zeros((parts, 0, 1), np.int64)
        rows = rows.where(F.lit(False))
    coded = written_once(encode(rows, books), "vector-codes")
    by_label = coded.groupBy("label").agg(
        F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"), F.count(F.lit(1)).alias("n")
    )
    by_label = written_once(by_label, "vector-labels")
    return look_up(coded, by_label, ["label"], "n").select(
        F.col("key").alias(key), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )
