"""The registered text queries: against their oracles where SQL can state them."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

import verify  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from tidewatch.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_oracle(spark, sf_dir, name):
    _, rows, same, note = verify.compare(spark, verify.connect(sf_dir), name, sf_dir)
    assert same, note
    assert rows > 0


@pytest.mark.parametrize(
    ("name", "columns"),
    {
        "op4_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
        "op5_nearest_neighbours": "query_id bigint, rank int, vec_id bigint, score double",
        "op6_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
        "op7_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
        "op8_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
        "op9_simhash_near_dedup": "doc_id bigint, fingerprint string, component_id bigint",
        "op10_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    }.items(),
)
def test_query_has_the_columns_and_covers_its_table(spark, sf_dir, name, columns):
    out = queries.QUERIES[name](spark, sf_dir)
    assert ", ".join(f"{c} {kind}" for c, kind in out.dtypes) == columns
    if name != "op5_nearest_neighbours":
        documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
        assert out.select("doc_id").distinct().count() == documents.count()


def test_entry_lists_all_operators_and_the_pipeline():
    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
