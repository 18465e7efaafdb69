"""Samples keep their bounds whatever the keys, and rare labels are in them."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tidewatch.llm import components, langid, sampling, token_files


def test_bound_holds_with_null_and_repeated_keys(spark):
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 != 0, F.col("id")).alias("k"), F.concat(F.lit("text "), F.col("id") % 20_000).alias("t")
    )
    assert sampling.at_most(rows, ["k", "t"], 2000).count() == 2000
    same = spark.range(40_000).select(F.lit(1).alias("k"), F.lit("same").alias("t"))
    assert sampling.at_most(same, ["k", "t"], 2000).count() == 1
    one = [sampling.at_most(spark.range(2_000_000), ["id"], 1).collect() for _ in range(2)]  # a share below a millionth
    assert len(one[0]) == 1 and one[0] == one[1]
    by = sampling.at_most(rows.withColumn("s", F.col("k") % 2), ["k", "t"], 70, F.col("s")).groupBy("s").count()
    assert {r["s"]: r["count"] for r in by.collect()} == {0: 70, 1: 70, None: 70}


def test_one_labelled_key_in_many_documents(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    docs = spark.range(40_000).select(F.when(F.col("id") > 0, 1).otherwise(2).cast("long").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    out = sampling.labelled_sample(docs, labels, "toxic", F.lit(True), 100)
    assert out.count() == 100
    assert out.columns == ["text", "label"]
    assert sampling.labelled_sample(docs, labels.limit(0), "toxic", F.lit(True), 100).count() == 0


def test_rare_labels_are_taken(spark):
    labels = spark.range(200_000).select(F.col("id").alias("doc_id"), (F.col("id") % 5000 == 7).cast("int").alias("toxic"))
    docs = labels.select("doc_id", F.lit("words").alias("text"))
    out = sampling.labelled_sample(docs, labels, "toxic", F.lit(True), 10_000)
    counts = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts == {0: 9960, 1: 40}
    assert sampling.quotas({0: 900, 1: 100}, 100) == {0: 90, 1: 10}
    assert sum(sampling.quotas({0: 10**12, 1: 10**12 + 1}, 12_000).values()) <= 12_000


def test_every_language_is_learned_whatever_the_keys(spark):
    rows = [(None, "le chat dort sur la table et il ronfle", "fr")] * 400 + [(None, "the cat sleeps on the table and it snores", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = langid.identify(docs, F.lit(True), rows_per_language=5)
    assert {r.lang_pred for r in out.collect()} == {"fr", "en"}


def test_ids_beyond_two_bytes_come_back(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    token_files.write(docs, f"{tmp_path}/t", path, end_id=100_257)
    ids = token_files.encoder(path).encode(["some words"])[0].tolist()
    out = {r.doc_id: r for r in token_files.read_digests(spark, f"{tmp_path}/t").collect()}
    import zlib

    import numpy as np

    assert out[1].ids_crc32 == zlib.crc32(np.array([*ids, 100_257], "<u4").tobytes())
    assert out[2].ids_crc32 == zlib.crc32(np.array([100_257], "<u4").tobytes())
    with pytest.raises(ValueError, match="need 4 bytes"):
        token_files.write(docs, f"{tmp_path}/u", path, end_id=100_257, width=2)


def test_a_rising_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    real = components.written_once
    monkeypatch.setattr(components, "written_once", lambda df, purpose: rounds.append(purpose) or real(df, purpose))
    links = spark.range(1000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    out = components.components(links)
    assert out.count() == 1001
    assert out.select("root").distinct().count() == 1
    assert rounds.count("components-joined") <= 12
