"""Exact duplicates: grouped by a 128-bit content hash, compared byte by byte inside a group.

Texts are equal when they are the same after every run of ASCII white space is
made one space. Each task first reduces its own copies to one row for a text, so
a text that a third of all documents share crosses the shuffle once for a task.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.groups import look_up
from tidewatch.llm.tables import unused
from tidewatch.session import written_once

SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text with each run of white space made one space; null is the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def content_hash(text: Column) -> Column:
    """128 bits of the UTF-8 text."""
    return F.unhex(F.md5(text.cast("binary")))


def _classes(texts: DataFrame) -> DataFrame:
    """One row for each different text: `hash`, `keep_id`, `group_size`, `digest`.

    The text is a grouping key beside its hash, so its bytes are what the
    aggregate compares, in every task before the shuffle and after it.
    """
    return (
        texts.groupBy("hash", "body")
        .agg(F.min("key").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .withColumn("digest", F.unhex(F.sha2(F.col("body").cast("binary"), 256)))
    )


def duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    content: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """For every row: `key`, `keep_id`, `group_size`, `kept`, `text_sha256`.

    `keep_id` is the smallest key among the rows of equal text, null only if none
    has a key; null keys are never kept before others. A row that repeats both key
    and text of the kept row counts as kept too (`deduplicate` keeps one). Null is
    the empty text; texts of white space alone are equal. Other columns are ignored.

    Hashes that two different texts share (`content` collides) are found by
    counting texts within a hash; only then are their documents looked up by hash
    and text, which sends texts through a shuffle again.
    """
    body = normalised(F.col(text))
    texts = docs.select(F.col(key).alias("key"), body.alias("body")).withColumn("hash", content(F.col("body")))
    classes = written_once(_classes(texts).drop("body"), "exact-classes")
    rows = written_once(texts.select("key", "hash"), "exact-rows")
    shared = classes.groupBy("hash").count().where("count > 1").select("hash")
    if shared.isEmpty():
        found = look_up(rows, classes, ["hash"], "group_size")
    else:
        shared = written_once(shared, "exact-collisions")
        clear = look_up(
            rows.join(shared, "hash", "left_anti"), classes.join(shared, "hash", "left_anti"), ["hash"], "group_size"
        )
        mixed = written_once(texts.join(shared, "hash", "left_semi"), "exact-mixed")
        found = clear.unionByName(
            look_up(mixed, written_once(_classes(mixed), "exact-mixed-classes"), ["hash", "body"], "group_size").drop("body")
        )
    return found.select(
        F.col("key").alias(key),
        "keep_id",
        "group_size",
        F.col("key").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each different text, with all columns as given: the row of the smallest key.

    Null keys come after all others; of rows with the same key and text any one stays.
    """
    name = unused(docs, "digest")
    digest = F.sha2(normalised(F.col(text)).cast("binary"), 256)
    kept = duplicates(docs, key, text).where("kept")
    own = unused(docs, "kept_key")
    kept = kept.select(F.col(key).alias(own), F.col("text_sha256").alias(f"{own}_digest")).distinct()
    same = F.col(key).eqNullSafe(F.col(own)) & (F.col(name) == F.col(f"{own}_digest"))
    return docs.withColumn(name, digest).join(kept, same, "left_semi").dropDuplicates([key, name]).drop(name)
