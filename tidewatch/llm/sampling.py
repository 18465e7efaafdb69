"""Bounded, repeatable samples of labelled rows to learn from."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import written_once

LEAST_SHARE = 64  # a rare label has one in so many rows of a sample, or all it has


def at_most(rows: DataFrame, by: list[str], wanted: int, stratum: Column | None = None) -> DataFrame:
    """At most `wanted` rows of each stratum, those with the smallest 64-bit hash of `by`.

    Rows equal in all of `by` count once, so no null or repeated key brings more. Strata are
    few: one hash of each comes to the driver. Only hashes are shuffled and sorted, and
    of these each task passes on `wanted` of a stratum.
    """
    marked = rows.withColumns({"_hash": F.xxhash64(*by), "_stratum": F.lit(0) if stratum is None else stratum})
    first = F.row_number().over(Window.partitionBy("_stratum").orderBy("_hash"))
    hashes = marked.select("_stratum", "_hash").distinct().withColumn("_at", first).where(F.col("_at") <= wanted)
    chosen = F.lit(False)
    for row in hashes.groupBy("_stratum").agg(F.max("_hash").alias("last")).collect():
        chosen = chosen | (F.col("_stratum").eqNullSafe(F.lit(row["_stratum"])) & (F.col("_hash") <= row["last"]))
    return marked.where(chosen).dropDuplicates(["_stratum", "_hash"]).drop("_stratum", "_hash")


def known_labels(labels: DataFrame, label: str, learn: Column, key: str = "doc_id") -> DataFrame:
    """`key`, `label` (0 or 1) of the keys that may be learned from, each once, by the mean of its labels."""
    return (
        labels.select(F.col(key).alias("key"), F.col(label).alias("label"))
        .dropna()
        .where(learn)
        .groupBy("key")
        .agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    )


def quotas(counts: dict[int, int], rows: int) -> dict[int, int]:
    """How many of each label to take: its share of `rows`, a rare one more, in all no more than `rows`."""
    total = sum(counts.values())
    if total <= rows:
        return dict(counts)
    taken = {k: min(n, max(rows * n // total, rows // LEAST_SHARE)) for k, n in counts.items()}
    most = max(taken, key=taken.get)
    taken[most] -= max(0, sum(taken.values()) - rows)
    return taken


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """At most `rows` texts with their label (0 or 1), written once: `text`, `label`.

    `learn` says which keys may be learned from. A key labelled more than once
    counts by its mean; null keys and labels teach nothing. Labels are taken by their
    shares, rare ones up to a 64th of the rows. The keys that are looked up are bounded by
    `rows`, so they can be sent to every task; if some occur in more documents than
    that, `rows` different ones of these are taken.
    """
    known = known_labels(labels, label, learn, key)
    counts = {row[0]: row[1] for row in known.groupBy("label").count().collect()}
    chosen = known.limit(0)
    for value, wanted in quotas(counts, rows).items():
        some = known.where(F.col("label") == value)
        chosen = chosen.unionByName(some if wanted == counts[value] else at_most(some, ["key"], wanted))
    texts = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = written_once(texts.join(F.broadcast(chosen), "key"), "labelled-sample")
    if found.count() > rows:
        found = written_once(at_most(found, ["key", "text"], rows), "labelled-sample")
    return found.select("text", "label")
