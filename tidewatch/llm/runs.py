"""Periodic runs of words, found by catching squares over dyadic blocks.

The words of a text are appended one after the other. Whenever a block of b words
is complete (b a power of two), a catcher is set up on it for the periods b to
2b - 1. Every word advances the comparisons of the suffixes that end at it: the
suffix of 2b words gets its name from the names of its two halves, so that two
suffixes of a dyadic length are compared by one number. A catcher compares its
block with the suffixes that end one period earlier. A period that holds on the
block and on the next one covers 2b words more than a period back: a square, which
is reported. Squares of one period that follow each other belong to one run; a
catcher goes on from a square only if the block before did not hold its period
already. What is reported is then compared word by word in both directions, which
gives the run's exact ends and does not rest on names.

A stretch in which words one period q apart are identical is whole on two blocks in
a row wherever it has 3q words, so no run of four periods is missed. Blocks inside a
known run of a smaller period are passed over: what they could catch has that
smaller period.

The catchers of one block length do not depend on each other, so they are advanced
together, for all texts of a portion. Work is a few operations on each word for each
block length up to a quarter of the text.
"""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.tables import map_batches

PERIODS = 4  # a run has at least so many periods
LEAST = 6  # and at least so many words
PORTION = 1 << 20  # bytes of text in a task's hands at once, or one text

Runs = list[tuple[int, int, int]]  # start, length, period


def _names(ids: np.ndarray) -> np.ndarray:
    """Well spread 64-bit names of single words."""
    return (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)


def _advance(names: np.ndarray, size: int) -> np.ndarray:
    """Names of 2 * `size` words from those of `size` words, at each first word."""
    head, tail = names[:-size], names[size:]
    mixed = (head ^ (head >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(29)
    return (mixed + tail) * np.uint64(0xFF51AFD7ED558CCD)


class _Known:
    """Runs found so far, as intervals of words."""

    def __init__(self) -> None:
        self.starts = self.ends = np.empty(0, np.int64)

    def add(self, starts: np.ndarray, ends: np.ndarray) -> None:
        starts, ends = np.append(self.starts, starts), np.append(self.ends, ends)
        order = np.argsort(starts, kind="stable")
        self.starts, self.ends = starts[order], np.maximum.accumulate(ends[order])

    def cover(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether one known run holds all words from `first` up to `end`."""
        if not len(self.starts):
            return np.zeros(np.shape(first), bool)
        at = np.searchsorted(self.starts, first, side="right") - 1
        return (at >= 0) & (self.ends[at] >= end)


def _caught(names: np.ndarray, size: int, known: _Known) -> tuple[np.ndarray, np.ndarray]:
    """First words and periods of the blocks at which a catcher reports a new square."""
    total = len(names)  # the number of words at which a block of `size` words may begin
    blocks = np.arange(1, -(-total // size))
    first = blocks * size
    first = first[first + size < total]
    if len(known.starts):
        first = first[~known.cover(np.maximum(first - 2 * size + 1, 0), first + size)]
    if not len(first):
        return first, first
    # row m of the table has the names that begin in block m; a period q of 1 to size - 1
    # words beyond a block looks back into column size - (q - size) of the last row but one
    at, period = [], []
    same = np.flatnonzero(names[first] == names[first - size])
    at.append(first[same])
    period.append(np.full(len(same), size))
    if size > 1:
        rows = first[first >= 2 * size] // size
        table = names[: total // size * size].reshape(-1, size)
        for start in range(0, len(rows), max(1, PORTION // size)):
            some = rows[start : start + max(1, PORTION // size)]
            row, column = np.nonzero(table[some - 2][:, 1:] == table[some][:, :1])
            at.append(some[row] * size)
            period.append(2 * size - 1 - column)
        early = first[first < 2 * size]  # the second block, which has less than two before it
        for block in early:
            column = np.flatnonzero(names[1:size] == names[block])
            at.append(np.full(len(column), block))
            period.append(block - 1 - column)
    at, period = np.concatenate(at), np.concatenate(period)
    inside = at >= period
    at, period = at[inside], period[inside]
    holds = names[at + size] == names[at + size - period]  # the next block too: a square
    at, period = at[holds], period[holds]
    earlier = at - size - period >= 0
    earlier[earlier] = names[at[earlier] - size] == names[at[earlier] - size - period[earlier]]
    at, period = at[~earlier], period[~earlier]
    fresh = ~known.cover(at - period, at + size)
    return at[fresh], period[fresh]


def _matched(ids: np.ndarray, at: int, period: int, step: int) -> int:
    """How many words from `at` on, in steps of 1 or -1, equal the words one period before."""
    done, width = 0, 32
    while True:
        if step > 0:
            now, old = ids[at + done : at + done + width], ids[at + done - period : at + done - period + width]
        else:
            end = at - done + 1
            begin = max(end - width, period)
            now, old = ids[begin:end][::-1], ids[begin - period : max(end - period, 0)][::-1]
        length = min(len(now), len(old))
        other = np.flatnonzero(now[:length] != old[:length])
        if len(other):
            return done + int(other[0])
        done += length
        if length < width:
            return done
        width *= 2


def find_runs(texts: list[np.ndarray]) -> list[Runs]:
    """All runs of each text, given as word numbers, by start and then period."""
    found: list[Runs] = [[] for _ in texts]
    sizes = np.array([len(ids) for ids in texts], np.int64)
    using = np.flatnonzero(sizes >= LEAST)
    if not len(using):
        return found
    # texts lie end to end, each followed by a number of its own: nothing matches across
    marks = int(max(ids.max() for ids in (texts[i] for i in using))) + 1 + np.arange(len(using))
    words = np.concatenate([part for i, mark in zip(using, marks) for part in (texts[i], [mark])]).astype(np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes[using] + 1)[:-1]])
    names, known, size = _names(words), _Known(), 1
    longest = int(sizes.max())
    while PERIODS * size <= longest:
        at, period = _caught(names, size, known)
        starts, ends = [], []
        for first, q in zip(at.tolist(), period.tolist()):
            back = _matched(words, first - 1, q, -1) if first > q else 0
            ahead = _matched(words, first, q, 1)
            length = back + ahead + q
            if length >= max(LEAST, PERIODS * q):
                starts.append((first - back - q, q))
                ends.append(first + ahead)
        if starts:
            ends = np.array(ends, np.int64)
            whole, unique = np.unique(np.array(starts, np.int64), axis=0, return_index=True)
            ends = ends[unique]
            new = ~known.cover(whole[:, 0], ends)  # within a run of a smaller period: that one is smallest
            for (start, q), end in zip(whole[new].tolist(), ends[new].tolist()):
                text = int(np.searchsorted(begins, start, side="right")) - 1
                found[using[text]].append((start - int(begins[text]), end - start, q))
            known.add(whole[new, 0], ends[new])
        if 2 * PERIODS * size > longest:
            break
        names = _advance(names, size)
        size *= 2
    for runs in found:
        runs.sort(key=lambda run: (run[0], run[2]))
    return found


def collapsed(words: list, runs: Runs) -> list:
    """The words without those that repeat: of every run the first period is kept."""
    if not runs:
        return words
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(kept)]


def _portions(texts: list[bytes]):
    """Slices of a batch of bounded size; a longer text is one alone."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > PORTION:
            yield start, i
            start, size = i, 0
        size += len(text)
    if len(texts) > start:
        yield start, len(texts)


def _of_portion(texts: list[bytes]) -> tuple[list[int], list[Runs], list[bytes]]:
    split = [text.split() for text in texts]  # ASCII white space, as UTF-8 bytes
    numbers: dict[bytes, int] = {}
    ids = [np.array([numbers.setdefault(word, len(numbers)) for word in words], np.int64) for words in split]
    runs = find_runs(ids)
    return [len(words) for words in split], runs, [b" ".join(collapsed(w, r)) for w, r in zip(split, runs)]


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row: `key`, `n_words`, `runs` (start, length, period), `collapsed`.

    Words are what lies between ASCII white space, numbered from 0. A run is a stretch
    whose words one period apart are identical, for its smallest period, of at
    least six words and four periods, that no neighbouring word extends. `runs` come by
    start, then period; `collapsed` has the words that no run repeats, joined by one
    space. Null is the empty text and has no words; rows are independent, so repeated
    rows and null keys come out as they went in. Other columns are ignored.
    """

    def of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [x or b"" for x in batch.column("body").to_pylist()]
        counts, runs, kept = [], [], []
        for start, end in _portions(texts):
            n, found, rest = _of_portion(texts[start:end])
            counts += n
            runs += [[{"start": s, "length": m, "period": q} for s, m, q in one] for one in found]
            kept += rest
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        columns = [batch.column("key"), pa.array(counts, pa.int64()), pa.array(runs, kind), pa.array(kept, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["key", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("body"))
    schema = f"key {rows.schema['key'].dataType.simpleString()}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"
    return map_batches(rows, of_batch, schema).select(
        F.col("key").alias(key), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed")
    )
