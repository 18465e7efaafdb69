"""Token ids of texts by a byte-level BPE, with work shared between equal words.

Byte-level BPE of this kind first cuts a text into words with the blank before
them, numbers, runs of marks and white space, and never joins across a cut. A
single blank between two other characters is always such a cut. Texts are parted
there; of many texts at once each different part is encoded once, and the parts
met first are kept for the texts to come. Texts with other white space beside a
blank, or with a special token, are encoded whole.
"""

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewatch.llm.tables import texts_of

LINE_BREAK, BLANK = "Ċ", "Ġ"  # in the vocabulary's spelling
PARTS_KEPT = 250_000
PARTS_AT_ONCE = 1 << 18
BYTES_AT_ONCE = 1 << 21
# White space beside a blank, at an end, or of a rare kind, which is taken for such wherever it stands.
UNCERTAIN = r"^\s|\s$|  | [\t-\r]|[\t-\r] |[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


class Encoder:
    """Encodes lists of texts with a tokenizer file, as the tokenizers library does."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # words come once here; looking them up first only costs time
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.opens, self.closes = (np.zeros(max(vocabulary.values()) + 1, bool) for _ in range(2))
        for token, number in vocabulary.items():
            self.opens[number] = token.startswith(BLANK)
            self.closes[number] = token[-1:] in (".", "!", "?", LINE_BREAK)
        self.place: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 16, np.int64)

    def sentence_ends(self) -> np.ndarray:
        """For every id whether a sentence or line can end with it."""
        return self.closes

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)  # keeps no offsets

    def learn(self, parts: list[str]) -> None:
        """Place new parts' ids, each with a blank before it, behind the known ones: one text of all is encoded."""
        ids = self.whole(" " + " ".join(parts))
        ends = np.append(np.flatnonzero(self.opens[ids])[1:], len(ids))
        if len(ends) != len(parts):  # a vocabulary whose words are not told apart by their blanks
            alone = [self.whole(" " + part) for part in parts]
            ids, ends = np.concatenate(alone), np.cumsum([len(one) for one in alone])
        known = len(self.place)
        start = int(self.ends[known - 1]) if known else 0
        while start + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while known + len(parts) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[start : start + len(ids)] = ids
        self.ends[known : known + len(parts)] = start + ends
        self.place.update(zip(parts, range(known, known + len(parts)), strict=True))

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts, end to end, and how many each has."""
        starts = np.where(at > 0, self.ends[at - 1], 0)
        lengths = self.ends[at] - starts
        before = np.cumsum(lengths) - lengths
        return self.flat[np.repeat(starts - before, lengths) + np.arange(lengths.sum())], lengths

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and how many each text has."""
        given = pa.array(texts, pa.large_string())
        cut = ~np.asarray(pc.match_substring_regex(given, UNCERTAIN))
        for token in self.special:
            cut &= ~np.asarray(pc.match_substring(given, token))
        # A text's first part has no blank before it and is encoded alone; an uncertain text is all first part.
        split = pc.split_pattern(given.filter(pa.array(cut)), " ")
        sizes = np.zeros(len(texts), np.int64)
        sizes[cut] = np.diff(np.asarray(split.offsets))
        first = np.cumsum(sizes) - sizes
        parts = split.flatten()
        heads = [self.whole(text if not sure else parts[at].as_py()) for text, sure, at in zip(texts, cut.tolist(), first.tolist(), strict=True)]
        others = np.ones(len(parts), bool)
        others[first[cut]] = False
        coded = parts.filter(pa.array(others)).dictionary_encode()
        different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = np.fromiter(map(self.place.get, different, repeat(-1)), np.int64, len(different))
        new = [different[i] for i in np.flatnonzero(at < 0).tolist()]
        if new:
            at[at < 0] = len(self.place) + np.arange(len(new))
            self.learn(new)
        at = at[np.asarray(coded.indices)]
        rest, lengths = [], []
        for k in range(0, len(at), PARTS_AT_ONCE):
            ids, counts = self.gather(at[k : k + PARTS_AT_ONCE])
            rest.append(ids)
            lengths.append(counts)
        if len(self.place) > PARTS_KEPT:
            for part in new:
                del self.place[part]
        # Each text's head goes before the ids of its other parts.
        behind = np.concatenate([[0], np.cumsum(np.concatenate([*lengths, np.zeros(0, np.int64)]))]).astype(np.int64)
        bounds = behind[np.concatenate([[0], np.cumsum(np.maximum(sizes - 1, 0))])]
        rest = np.concatenate([*rest, np.zeros(0, np.uint32)])
        pieces = [x for i, head in enumerate(heads) for x in (head, rest[bounds[i] : bounds[i + 1]])]
        counts = np.diff(bounds) + np.array([len(head) for head in heads], np.int64)
        return np.concatenate([*pieces, np.zeros(0, np.uint32)]), counts


def steps(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Consecutive rows of a batch with a few MB of text, a longer text alone, and their texts; null is empty."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and held + size > BYTES_AT_ONCE:
            part = batch.slice(start, i - start)
            yield part, texts_of(part, column)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        part = batch.slice(start)
        yield part, texts_of(part, column)


def in_order(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id`, `text` dealt out by ranges of the id and sorted within them.

    Rows of one id may lie in several neighbouring ranges, in order of a hash of
    their texts; null ids come first, a null text is empty.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    hashed = rows.withColumn("tie", F.xxhash64("text"))
    return hashed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")


def behind(parts: DataFrame, part: str, size: str, name: str) -> DataFrame:
    """`part` and `name`: the sum of `size` over all parts before it.

    One row for each task of a job comes to the driver and goes back out.
    """
    sizes = parts.groupBy(part).agg(F.sum(size).alias("size")).orderBy(part).collect()
    before = np.concatenate([[0], np.cumsum([row["size"] for row in sizes], dtype=np.int64)])
    rows = [(row[part], int(start)) for row, start in zip(sizes, before, strict=False)]
    return parts.sparkSession.createDataFrame(rows, f"{part} int, {name} long")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer file, one for each Python worker."""
    return Encoder(path)
