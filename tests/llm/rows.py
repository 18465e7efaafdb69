"""Awkward documents that every operator has to take: nulls, empties, repeats, ties, long texts, odd columns."""

from pyspark.sql.types import StructType

LONG = "the quick onion sang to a lamp. " * 4000
DOCS = [
    (1, "a plain text of some few words, nothing else", "en"),
    (2, None, "en"),
    (3, "", None),
    (4, " \n\t ", "de"),
    (5, LONG, "en"),
    (6, "a plain text of some few words, nothing else", "en"),
    (7, "Ünïcødé 😀 <|endoftext|> ein  Satz.\nNoch einer!", "de"),
    (7, "Ünïcødé 😀 <|endoftext|> ein  Satz.\nNoch einer!", "de"),
    (None, "a text without an id", None),
    (None, None, None),
]


def awkward(spark, **extra):
    """The documents, with further columns of the given names and one value each."""
    schema = "doc_id long, text string, lang string" + "".join(f", {name} string" for name in extra)
    return spark.createDataFrame([(*row, *extra.values()) for row in DOCS], schema)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def labels(spark, name, rows):
    return spark.createDataFrame(rows, f"doc_id long, {name} int")


def no_labels(spark, name):
    return spark.createDataFrame([], StructType().add("doc_id", "long").add(name, "integer"))
