"""SimHash near-duplicates found by meeting in the middle of Hamming balls.

Two fingerprints at most 2r bits apart have a variant in common that is at most
r bits from either. Every distinct fingerprint sends all its variants within r
bits through one shuffle; those that meet at a variant are linked.
"""

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.components import components
from tidewatch.llm.tables import texts_of, unused, with_columns
from tidewatch.session import written_once

SEED = 42
ROWS_AT_ONCE = 1 << 16


def fingerprint(text: str, shingle_words: int = 3) -> int:
    """The 64-bit SimHash of a text: a bit is set if over half the shingles' XXH64 set it.

    A-Z are lower-cased, words are runs of anything but ASCII white space. Fewer
    words than a shingle make one shingle of all; no words give 0.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    ones = np.zeros(64, np.int64)
    count = len(words) - shingle_words + 1
    for start in range(0, count, ROWS_AT_ONCE):
        part = words[start : min(start + ROWS_AT_ONCE, count) + shingle_words - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(shingle_words)), strict=False))
        hashes = np.array(list(map(xxhash.xxh64_intdigest, shingles, repeat(SEED))), np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, text: str = "text", shingle_words: int = 3, name: str = "fingerprint") -> DataFrame:
    """The table with the fingerprint's 64 bits as a long; null is the empty text."""

    def of_batch(batch: pa.RecordBatch) -> list[pa.Array]:
        found = np.array([fingerprint(x, shingle_words) for x in texts_of(batch, text)], np.uint64)
        return [pa.array(found.view(np.int64))]

    return with_columns(docs, of_batch, {name: "long"})


def variants(fingerprint: Column, radius: int) -> Column:
    """All values within `radius` bits."""
    masks = [0]
    for size in range(1, radius + 1):
        masks += [sum(1 << bit for bit in bits) for bits in combinations(range(64), size)]
    signed = [mask - (1 << 64) if mask >> 63 else mask for mask in masks]
    return F.transform(F.array(*map(F.lit, signed)), lambda mask: fingerprint.bitwiseXOR(mask))


def links(distinct: DataFrame, max_bits: int = 2) -> DataFrame:
    """`a`, `b`: links that connect all distinct `fingerprint`s up to `max_bits` apart.

    All that meet at a variant lie within 2r bits of each other, so each is
    linked with the one before it only, not with all. `max_bits` is even.
    """
    if max_bits % 2:
        raise ValueError("max_bits must be even: both sides of a pair meet halfway")
    met = distinct.select("fingerprint", F.explode(variants(F.col("fingerprint"), max_bits // 2)).alias("variant"))
    before = F.lag("fingerprint").over(Window.partitionBy("variant").orderBy("fingerprint"))
    return (
        met.select(before.alias("a"), F.col("fingerprint").alias("b"))
        .where("a IS NOT NULL")
        .distinct()
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    )


def classes(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """`fingerprint`, `root` for every fingerprint: equal roots are connected."""
    distinct = prints.select("fingerprint").distinct()
    found = components(links(distinct, max_bits)).withColumnRenamed("node", "fingerprint")
    return written_once(
        distinct.join(found, "fingerprint", "left").select("fingerprint", F.coalesce("root", "fingerprint").alias("root")),
        "simhash-classes",
    )


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle_words: int = 3, max_bits: int = 2
) -> DataFrame:
    """`doc_id`, `fingerprint` (16 hex digits), `component_id`: the smallest key reachable.

    Documents link if their fingerprints differ in at most `max_bits` bits; texts
    without words have fingerprint 0 and link like others, null is the empty
    text. Copies share a fingerprint, and everything but the last join works on
    distinct fingerprints: copies are never paired. A row comes out for each row
    in, repeated rows included; a null key is smaller than none, so a component
    has a null id only if all its keys are null. Other columns are ignored.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    prints = written_once(
        with_fingerprints(rows, "text", shingle_words).select("doc_id", "fingerprint"), "simhash-fingerprints"
    )
    rooted = classes(prints, max_bits)
    first = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    smallest = rooted.join(first, "fingerprint").groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(smallest, "root").select("fingerprint", "component_id")
    return prints.join(named, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle_words: int = 3, max_bits: int = 2
) -> DataFrame:
    """One row of each component, with all columns as given: the row of the smallest key.

    Null keys come after all others; of rows with the same key and fingerprint
    any one stays.
    """
    name = unused(docs, "fingerprint")
    printed = written_once(with_fingerprints(docs, text, shingle_words, name), "simhash-documents")
    prints = printed.select(F.col(key).alias("doc_id"), F.col(name).alias("fingerprint"))
    best = prints.groupBy("fingerprint").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id")).alias("best"))
    kept = (
        classes(prints, max_bits)
        .join(best, "fingerprint")
        .groupBy("root")
        .agg(F.min(F.struct("best.none", "best.doc_id", "fingerprint")).alias("best"))
        .select(F.col("best.doc_id").alias("_kept"), F.col("best.fingerprint").alias("_print"))
    )
    same = printed[key].eqNullSafe(kept["_kept"]) & (printed[name] == kept["_print"])
    return printed.join(kept, same, "left_semi").dropDuplicates([key, name]).drop(name)
