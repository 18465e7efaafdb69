import hashlib
import re

import rows
from pyspark.sql import functions as F
from tidewatch.llm import exact_dedup


def plain(pairs):
    """(key, text) rows in, the five columns out, by the rule itself."""
    bodies = [re.sub(r"[\x20\x09-\x0D]+", " ", text or "") for _, text in pairs]
    groups = {}
    for (key, _), body in zip(pairs, bodies, strict=True):
        groups.setdefault(body, []).append(key)
    out = []
    for (key, _), body in zip(pairs, bodies, strict=True):
        keep = min((k for k in groups[body] if k is not None), default=None)
        out.append((key, keep, len(groups[body]), key == keep, hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=str)


def have(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_awkward_rows_equal_the_rule(spark):
    docs = rows.awkward(spark, hash="x", keep_id="y", body="z", _key="k")
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    assert have(exact_dedup.duplicates(docs)) == plain(pairs)
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 4, 5, 7]
    assert exact_dedup.duplicates(rows.empty(spark)).count() == 0
    assert exact_dedup.deduplicate(rows.empty(spark)).count() == 0


def test_white_space_and_case(spark):
    texts = ["a b", "a  b", "a\t\n b", " a b", "a b ", "A b", "a b", "a\u0085b", "\x0b", " ", "", None, "a\x00b"]
    pairs = [(i, t) for i, t in enumerate(texts)]
    assert have(exact_dedup.duplicates(spark.createDataFrame(pairs, "doc_id long, text string"))) == plain(pairs)


def test_a_hash_that_collides_does_not_join_texts(spark):
    pairs = [(i, f"text {i % 7}  of {'x' * (i % 2)}") for i in range(300)] + [(None, "text 1"), (None, None)]
    docs = spark.createDataFrame(pairs, "doc_id long, text string").repartition(8)
    weak = exact_dedup.duplicates(docs, content=lambda text: F.md5(F.length(text).cast("string")).cast("binary"))
    assert have(weak) == plain(pairs)


def test_a_hot_text_and_many_others(spark):
    docs = spark.range(30_000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "the same  everywhere").otherwise(F.concat(F.lit("no. "), F.col("id") % 9_000)).alias("text"),
    )
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    assert have(exact_dedup.duplicates(docs)) == plain(pairs)
