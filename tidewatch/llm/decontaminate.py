"""Benchmark decontamination: an FM-index of each shard of the training texts.

Words are cut out of lower-cased texts. A phrase is a window of consecutive words
of a benchmark item, or a whole shorter item. In a shard, words that no phrase has
become separators, and what lies between separators and is shorter than the
shortest phrase is left out; the rest is indexed. All phrases are searched
backward at once, what they match is located, and overlapping occurrences merge
into spans.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.fm_index import FmIndex
from tidewatch.llm.tables import texts_of, unused, with_columns
from tidewatch.session import written_once

WINDOW = 13
BLOCK_WORDS = 2_000_000
SHARD_CHARACTERS = 1 << 23
OCCURRENCES_AT_ONCE = 1 << 20

# From bytes to bytes: A-Z in lower case; all ASCII but digits and letters becomes a blank.
PLAIN = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(PLAIN).split()


@dataclass
class Phrases:
    """Phrases of some items: words by number from 1, distinct phrases by length, and whose they are."""

    words: dict[bytes, int]
    by_length: dict[int, tuple[np.ndarray, list[list[str]]]]

    @property
    def shortest(self) -> int:
        return min(self.by_length, default=0)


def phrases_of(items: list[tuple[str, list[bytes]]], window: int) -> Phrases:
    words: dict[bytes, int] = {}
    owners: dict[int, dict[tuple[int, ...], set[str]]] = {}
    for item, text in items:
        numbers = [words.setdefault(word, len(words) + 1) for word in text]
        size = min(window, len(numbers))
        for start in range(len(numbers) - size + 1 if size else 0):
            owners.setdefault(size, {}).setdefault(tuple(numbers[start : start + size]), set()).add(item)
    return Phrases(
        words,
        {size: (np.array(list(found), np.int64), [sorted(x) for x in found.values()]) for size, found in owners.items()},
    )


def item_blocks(benchmark: DataFrame, item: str, text: str, window: int, block_words: int) -> Iterator[Phrases]:
    """The benchmark's phrases in blocks of a bounded number of words; rows come to the driver a block at a time."""
    items: list[tuple[str, list[bytes]]] = []
    size = 0
    for row in benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).toLocalIterator():
        found = words_of(row["text"] or "")
        items.append((row["item"] if row["item"] is not None else "null", found))
        size += len(found)
        if size >= block_words:
            yield phrases_of(items, window)
            items, size = [], 0
    if items:
        yield phrases_of(items, window)


def occurrences(symbols: np.ndarray, phrases: Phrases) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, phrase numbers and places of all occurrences in symbols with separators (0), in portions."""
    known = np.concatenate([[0], (symbols > 0).astype(np.int8), [0]])
    starts, ends = np.flatnonzero(np.diff(known) == 1), np.flatnonzero(np.diff(known) == -1)
    long = ends - starts >= phrases.shortest
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return
    sizes = ends - starts + 1  # with a separator behind each stretch
    moved = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    kept = symbols[np.minimum(moved, len(symbols) - 1)].copy()
    kept[np.cumsum(sizes) - 1] = 0
    index = FmIndex(kept, len(phrases.words) + 1)
    for length, (patterns, _) in phrases.by_length.items():
        found, low, high = index.search(patterns)
        many = np.cumsum(high - low)
        at = 0
        while at < len(found):
            upto = max(at + 1, int(np.searchsorted(many, (many[at - 1] if at else 0) + OCCURRENCES_AT_ONCE, side="right")))
            counts = (high - low)[at:upto]
            rows = np.repeat(low[at:upto] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            yield length, np.repeat(found[at:upto], counts), moved[index.locate(rows)]
            at = upto


def scan_shard(texts: list[str], phrases: Phrases) -> tuple[np.ndarray, list[set[str]], list[np.ndarray]]:
    """Of each text: the number of words, the items that occur, and the merged spans (first word, word behind)."""
    numbers, sizes = [], []
    get = phrases.words.get
    for text in texts:
        words = words_of(text)
        numbers.append(np.fromiter(map(get, words, repeat(0)), np.int64, len(words)))
        numbers.append(np.zeros(1, np.int64))
        sizes.append(len(words))
    starts = np.cumsum([0, *(size + 1 for size in sizes)])
    symbols = np.concatenate(numbers)
    edges = np.zeros(len(symbols) + 1, np.int64)
    items: list[set[str]] = [set() for _ in texts]
    for length, phrase, place in occurrences(symbols, phrases):
        np.add.at(edges, place, 1)
        np.add.at(edges, place + length, -1)
        doc = np.searchsorted(starts, place, side="right") - 1
        owners = phrases.by_length[length][1]
        for pair in np.unique(doc * len(owners) + phrase).tolist():
            items[pair // len(owners)].update(owners[pair % len(owners)])
    hit = np.concatenate([[0], (np.cumsum(edges) > 0).astype(np.int8)])
    first, behind = np.flatnonzero(np.diff(hit) == 1), np.flatnonzero(np.diff(hit) == -1)
    bounds = np.searchsorted(first, starts)
    spans = [
        np.column_stack([first[a:b], behind[a:b]]) - start
        for a, b, start in zip(bounds[:-1], bounds[1:], starts[:-1], strict=True)
    ]
    return np.array(sizes, np.int64), items, spans


def merged(old: list[dict], new: np.ndarray) -> list[dict]:
    """Spans of two passes, overlapping and touching ones as one."""
    spans = sorted([*((x["first"], x["behind"]) for x in old), *map(tuple, new.tolist())])
    out: list[dict] = []
    for first, behind in spans:
        if out and first <= out[-1]["behind"]:
            out[-1]["behind"] = max(out[-1]["behind"], behind)
        else:
            out.append({"first": first, "behind": behind})
    return out


SPANS = "array<struct<first:bigint,behind:bigint>>"


def shards(texts: list[str]) -> Iterator[slice]:
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > SHARD_CHARACTERS:
            yield slice(start, i)
            start, size = i, 0
        size += len(text)
    yield slice(start, len(texts))


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> tuple[DataFrame, dict[str, str]]:
    """The table with the words, items and spans found, and what these columns are called.

    Columns `n_words`, `items` (ids as text, in order) and `spans` (first word and
    the word behind, merged) are added under names not in use. Documents are not
    shuffled; the benchmark is searched in blocks of `block_words` words, each
    over all documents. A null text has no words; an empty item has no phrase; a
    null item id is called null. Repeated rows of either table change nothing
    else. Without benchmark rows nothing is found.
    """
    names = {name: unused(docs, name) for name in ("n_words", "items", "spans")}
    kinds = dict(zip(names.values(), ("bigint", "array<string>", SPANS), strict=True))
    span = pa.list_(pa.struct([("first", pa.int64()), ("behind", pa.int64())]))

    def searched(phrases: Phrases, again: bool):
        def of_batch(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = texts_of(batch, text)
            sizes, items, spans = [], [], []
            for shard in shards(texts):
                n, found, places = scan_shard(texts[shard], phrases)
                sizes.append(n)
                items += found
                spans += places
            if again:
                old_items, old_spans = (batch.column(names[x]).to_pylist() for x in ("items", "spans"))
                items = [new.union(old) for new, old in zip(items, old_items, strict=True)]
            else:
                old_spans = [[]] * len(spans)
            return [
                pa.array(np.concatenate(sizes)),
                pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                pa.array([merged(old, new) for old, new in zip(old_spans, spans, strict=True)], span),
            ]

        return of_batch

    scanned = None
    for phrases in item_blocks(benchmark, item, item_text, window, block_words):
        if scanned is None:
            scanned = with_columns(docs, searched(phrases, False), kinds)
        else:
            fresh = {f"new_{unused(scanned, name)}": kind for name, kind in kinds.items()}
            found = with_columns(written_once(scanned, "decontaminate"), searched(phrases, True), fresh)
            scanned = found.drop(*kinds).withColumnsRenamed(dict(zip(fresh, kinds, strict=True)))
    if scanned is None:
        scanned = with_columns(docs, searched(Phrases({}, {}), False), kinds)
    return scanned, names


def hits(spans: str) -> F.Column:
    """How many words the spans hold."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["behind"] - x["first"])


def contaminated(n_hit, n_words):
    """At least a twentieth of the words, and at least one, is the benchmark's."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def report(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`doc_id`, `n_words`, `n_hit`, `n_items`, `items_sha256`, `contaminated`, `spans` of every row."""
    found, _ = scan(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), benchmark, **options)
    return found.withColumn("n_hit", hits("spans")).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
        "spans",
    )


def cut_out(text: str, spans: list[dict]) -> str:
    """The text without the words of the spans and what stands between those of one span."""
    data = text.encode("utf-8", "surrogatepass")
    plain = np.frombuffer(data.translate(PLAIN), np.uint8) != 0x20
    edge = np.diff(np.concatenate([[0], plain.astype(np.int8), [0]]))
    first, behind = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    kept, at = [], 0
    for span in spans:
        kept.append(data[at : first[span["first"]]])
        at = behind[span["behind"] - 1]
    return b"".join([*kept, data[at:]]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", cut: bool = False, **options) -> DataFrame:
    """The documents that are not contaminated, as they were given.

    With `cut`, all documents stay and lose the removal spans instead; texts
    without a span are not changed.
    """
    found, names = scan(docs, benchmark, text, **options)
    if not cut:
        n_hit = hits(names["spans"])
        return found.where(~contaminated(n_hit, F.col(names["n_words"]))).select(*docs.columns)
    name = unused(found, "cut")

    def of_batch(batch: pa.RecordBatch) -> list[pa.Array]:
        rows = zip(batch.column(text).to_pylist(), batch.column(names["spans"]).to_pylist(), strict=True)
        return [pa.array([cut_out(x, spans) if spans else x for x, spans in rows], pa.string())]

    return with_columns(found, of_batch, {name: "string"}).withColumn(text, F.col(name)).select(*docs.columns)
