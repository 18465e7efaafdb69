"""Language identification by prediction by partial matching (PPM).

For every language a context tree over bytes, up to three bytes deep, counts
what follows each context. A byte costs -log2(n / (T + D)) bits where it was seen
n times after the longest context that has seen it (T bytes, D distinct ones in
all); each longer known context that has not seen it adds an escape of
-log2(D / (T + D)); a byte unknown to all costs 8 bits after the last escape. The
counts are frozen: a text's code length is the sum over its bytes, and the
language with the shortest code wins.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.sampling import at_most
from tidewatch.llm.tables import map_batches, with_columns

DEPTH = 3
START = b"\n" * DEPTH
BYTES_AT_ONCE = 1 << 21
UNDETERMINED = "und"


def coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes, each led in by the start context, and the place behind each text."""
    parts = [START + text.lower().encode("utf-8", "surrogatepass") for text in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(part) for part in parts])


def grams(data: np.ndarray, start: int, end: int) -> np.ndarray:
    """The four bytes that end at each place from `start` on, as one number."""
    wide = data[start - DEPTH : end].astype(np.uint32)
    n = end - start
    return wide[:n] << 24 | wide[1 : n + 1] << 16 | wide[2 : n + 2] << 8 | wide[3 : n + 3]


@dataclass
class Node:
    """One depth of a language's tree: bytes seen and contexts known, with their costs in bits."""

    seen: np.ndarray
    seen_bits: np.ndarray
    contexts: np.ndarray
    escape_bits: np.ndarray


def tree(keys: np.ndarray, counts: np.ndarray) -> list[Node]:
    """The levels of a tree, longest context first, from four-byte counts."""
    levels = []
    for depth in range(DEPTH, -1, -1):
        mask = np.uint32(0xFFFFFFFF >> 8 * (DEPTH - depth))
        seen, place = np.unique(keys & mask, return_inverse=True)
        times = np.bincount(place, counts, len(seen))
        contexts, at = np.unique(seen >> np.uint32(8) if depth else np.zeros(len(seen), np.uint32), return_inverse=True)
        total = np.bincount(at, times, len(contexts))
        kinds = np.bincount(at, minlength=len(contexts))
        levels.append(
            Node(seen, -np.log2(times / (total + kinds)[at]), contexts, -np.log2(kinds / (total + kinds)))
        )
    return levels


def found(known: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each asked value is among the known ones, and whether it is there."""
    place = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return place, known[place] == asked


def bits(levels: list[Node], asked: np.ndarray) -> np.ndarray:
    """What the last byte of each four costs after the three before it."""
    cost = np.zeros(len(asked))
    left = np.arange(len(asked))
    for k, node in enumerate(levels):
        depth = DEPTH - k
        key = asked[left] & np.uint32(0xFFFFFFFF >> 8 * k)
        place, there = found(node.seen, key)
        cost[left[there]] += node.seen_bits[place[there]]
        left, key = left[~there], key[~there]
        place, there = found(node.contexts, key >> np.uint32(8) if depth else np.zeros(len(key), np.uint32))
        cost[left[there]] += node.escape_bits[place[there]]
    cost[left] += 8
    return cost


def code_lengths(trees: list[list[Node]], texts: list[str]) -> np.ndarray:
    """Bits of each text (rows) under each tree (columns); a few MB of bytes at once."""
    data, ends = coded(texts)
    total = np.zeros((len(texts), len(trees)))
    for start in range(DEPTH, len(data), BYTES_AT_ONCE):
        end = min(start + BYTES_AT_ONCE, len(data))
        asked, place = np.unique(grams(data, start, end), return_inverse=True)
        costs = np.stack([bits(levels, asked) for levels in trees], axis=1)
        first, last = np.searchsorted(ends, [start, end - 1], side="right")
        for doc in range(first, last + 1):
            low = max(start, (ends[doc - 1] if doc else 0) + DEPTH) - start
            high = min(end, ends[doc]) - start
            if high > low:
                total[doc] += costs[place[low:high]].sum(axis=0)
    return total


def learn_trees(rows: DataFrame, text: str, lang: str) -> dict[str, list[Node]]:
    """A tree for each language of the rows. Tasks count four bytes each, Spark adds up.

    What reaches the driver is one row per language and distinct four bytes of
    the rows, which the caller bounds.
    """

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs = np.array(batch.column("lang").to_pylist(), object)
        texts = batch.column("text").to_pylist()
        parts = []
        for name in sorted(set(langs)):
            data, ends = coded([texts[i] for i in np.flatnonzero(langs == name)])
            inside = np.ones(len(data), bool)
            starts = np.concatenate([[0], ends[:-1]])
            for k in range(DEPTH):
                inside[starts + k] = False
            keys, counts = np.unique(grams(data, DEPTH, len(data))[inside[DEPTH:]], return_counts=True)
            parts.append((pa.array([name] * len(keys), pa.string()), keys.astype(np.int64), counts))
        return pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([part[0] for part in parts]),
                pa.array(np.concatenate([part[1] for part in parts])),
                pa.array(np.concatenate([part[2] for part in parts])),
            ],
            ["lang", "gram", "n"],
        )

    given = rows.select(F.col(lang).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counted = map_batches(given, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = counted.toArrow()
    langs = np.array(table["lang"].to_pylist(), object)
    keys, counts = (table[name].to_numpy() for name in ("gram", "n"))
    return {
        name: tree(keys[langs == name].astype(np.uint32), counts[langs == name])
        for name in sorted(set(langs.tolist()))
    }


def predict(docs: DataFrame, trees: dict[str, list[Node]], text: str = "text") -> DataFrame:
    """The table with `lang_pred` and `score`.

    The score is the language's share under equal priors, 2^-bits normalised. A
    null text, one without a letter, or no known language gives `und` and 0; of
    languages with equal codes the first by name is taken.
    """
    names = sorted(trees)
    levels = [trees[name] for name in names]

    def of_batch(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = batch.column(text).to_pylist()
        known = [bool(names) and bool(x) and any(map(str.isalpha, x)) for x in texts]
        langs = np.full(len(texts), UNDETERMINED, object)
        scores = np.zeros(len(texts))
        where = np.flatnonzero(known)
        if len(where):
            costs = code_lengths(levels, [texts[i] for i in where])
            best = costs.argmin(axis=1)
            gaps = np.minimum(costs - costs.min(axis=1, keepdims=True), 1000)
            scores[where] = 1 / np.exp2(-gaps).sum(axis=1)
            langs[where] = [names[k] for k in best]
        return [pa.array(langs.tolist(), pa.string()), pa.array(scores)]

    return with_columns(docs, of_batch, {"lang_pred": "string", "score": "double"})


def identify(
    docs: DataFrame, learn: Column, rows_per_language: int = 3000, key: str = "doc_id", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """`doc_id`, `lang_pred`, `score` of every row.

    Learns from the rows where `learn` holds and `lang` is not null, at most
    `rows_per_language` of each language, chosen by a hash of key and text; rows that
    repeat both teach once. Text is lower-cased. Repeated rows are scored as often as
    they occur; an empty table gives no rows; other columns are ignored.
    """
    known = docs.where(learn & F.col(lang).isNotNull())
    sample = at_most(known.select(key, text, lang), [key, text], rows_per_language, F.col(lang))
    trees = learn_trees(sample, text, lang)
    given = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return predict(given, trees).select("doc_id", "lang_pred", "score")
