"""Packing documents into sequences, in order, by dynamic programming over cuts.

The ids of documents lie end to end. A sequence ends at a cut: behind a document,
behind a sentence, or, so that no stretch is without one, at every 64th id of a
longer one. The best cuts minimise padding plus a penalty for each cut that
truncates a sentence or a document. The cost of ending at i is the least, over
all cuts j up to 2048 ids before, of the cost of ending at j plus the padding
2048 - (i - j): the sum of f(j) + j has to be least, which a queue that is kept
monotone gives in constant time. Lengths that are powers of two need no padding
and are tried as well.
"""

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.tokens import behind, encoder, in_order, steps
from tidewatch.session import ship_package, written_once

LENGTH = 2048
GRID = 64
SENTENCE, ANYWHERE, SEQUENCE = 4, 16, 8  # what a cut in a document costs, and each further sequence, in ids of padding


def cuts_of(ids: np.ndarray, ends: np.ndarray, sentence_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where a sequence may end, rising, and what each costs; the first is 0."""
    total = len(ids)
    cost = np.full(total + 1, -1, np.int8)
    cost[1:][sentence_ends[np.minimum(ids, len(sentence_ends) - 1)]] = SENTENCE
    cost[0] = cost[ends] = 0
    natural = np.flatnonzero(cost >= 0)
    more = np.maximum(0, -(-np.diff(natural) // GRID) - 1)
    inner = np.repeat(natural[:-1], more) + GRID * (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1)
    tail = np.arange(total - LENGTH, total, GRID)
    extra = np.concatenate([inner, tail[tail > 0]])
    cost[extra[cost[extra] < 0]] = ANYWHERE
    places = np.flatnonzero(cost >= 0)
    costs = cost[places].astype(np.int64)
    return places, costs


def best_cuts(places: np.ndarray, costs: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The places where sequences end, at least total cost; needs no gap above `length`."""
    exact_ends, exact_starts = [], []
    size = length // 2
    while size >= GRID:
        at = np.minimum(np.searchsorted(places, places - size), len(places) - 1)
        same = np.flatnonzero(places[at] == places - size)
        exact_ends.append(same)
        exact_starts.append(at[same])
        size //= 2
    order = np.argsort(np.concatenate(exact_ends), kind="stable")
    exact = zip(np.concatenate(exact_ends)[order].tolist(), np.concatenate(exact_starts)[order].tolist(), strict=True)
    end, start = next(exact, (-1, -1))
    where, price = places.tolist(), (costs + SEQUENCE).tolist()
    least = [0] * len(where)
    came = [0] * len(where)
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (f(j) + place of j, j), rising
    for i in range(1, len(where)):
        here = where[i]
        while where[queue[0][1]] < here - length:
            queue.popleft()
        value, from_j = queue[0][0] + length - here, queue[0][1]
        while end == i:
            if least[start] < value:
                value, from_j = least[start], start
            end, start = next(exact, (-1, -1))
        value += price[i]
        least[i], came[i] = value, from_j
        mark = value + here
        while queue and queue[-1][0] >= mark:
            queue.pop()
        queue.append((mark, i))
    found = []
    i = len(where) - 1
    while i:
        found.append(where[i])
        i = came[i]
    return np.array(found[::-1], np.int64)


def pack(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece of a document: its place in the document and in a sequence.

    `doc_id`, `start`, `length`, `ids_crc32`, `doc_tokens`, `sequence_id`, `offset`.
    Documents are taken in order of the key and cut into stretches of a few
    MB of text, a longer document alone; each stretch is packed at best,
    and sequences are numbered through all of them. A null or empty text has the
    end id only. Null keys come first, repeated rows are documents of their own,
    an empty table has no pieces; other columns are ignored.
    """
    ship_package(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    schema = (
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, part int, local long, offset long"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sequences = TaskContext.get().partitionId(), 0
        encode = encoder(tokenizer)
        sentence_ends = encode.sentence_ends()
        for batch in batches:
            for rows, texts in steps(batch):
                ids, counts = encode.encode(texts)
                ends = np.cumsum(counts + 1)
                ids = np.insert(ids, np.cumsum(counts), np.uint32(end_id))
                cuts = best_cuts(*cuts_of(ids, ends, sentence_ends))
                starts = np.unique(np.concatenate([[0], ends[:-1], cuts[:-1]]))
                lengths = np.diff(np.append(starts, len(ids)))
                doc = np.searchsorted(ends, starts, side="right")
                sequence = np.searchsorted(cuts, starts, side="right")
                data = ids.astype("<u4").tobytes()
                checks = [zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id").take(pa.array(doc)),
                        pa.array(starts - (ends - counts - 1)[doc]),
                        pa.array(lengths),
                        pa.array(checks, pa.int64()),
                        pa.array((counts + 1)[doc]),
                        pa.array(np.full(len(doc), part, np.int32)),
                        pa.array(sequence + sequences),
                        pa.array(starts - np.concatenate([[0], cuts])[sequence]),
                    ],
                    [column.split(" ")[0] for column in schema.split(", ")],
                )
                sequences += len(cuts)

    pieces = written_once(in_order(docs, key, text).mapInArrow(run, schema), "packing-pieces")
    sizes = pieces.groupBy("part").agg((F.max("local") + 1).alias("sequences"))
    return pieces.join(F.broadcast(behind(sizes, "part", "sequences", "before")), "part").select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("before") + F.col("local")).alias("sequence_id"),
        "offset",
    )
