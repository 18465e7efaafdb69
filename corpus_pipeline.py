"""A training corpus from raw documents: filter, deduplicate, decontaminate, pack."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import decontaminate, packing, quality, simhash, toxicity
from tidewatch.llm.tables import remainder, table, unused
from tidewatch.session import shared_dir

ACCEPT = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; learned from labelled documents among those given."""
    grammar = toxicity.learned(docs, table(spark, sf_dir, "labels"), remainder("key", 3) != 1)
    name = unused(docs, "score")
    return toxicity.with_toxicity(docs, grammar, name=name).where(F.col(name) < ACCEPT).drop(name)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the quality threshold go; learned from labelled documents among those given."""
    name = unused(docs, "score")
    judged = quality.judge(docs, table(spark, sf_dir, "labels"), remainder("key", 4) != 2, name)
    return judged.where(F.col(name) >= ACCEPT).drop(name)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash.keep_first(docs, shingle_words=3, max_bits=2)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which at least a twentieth is the benchmark's go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of at most 2048 ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_classifier", keep_good),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack),
]

# Learned models and tokenizers cannot be stated in SQL; the tests hold a brute-force version against it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_dir(spark, "pipeline")
    for place, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{place}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
