import itertools

import corpus_pipeline
import public_tokenizers
import rows
from test_decontaminate import expected
from test_simhash import groups, plain_fingerprint
from test_tokens import check_pieces
from tokenizers import Tokenizer


def test_stages_one_by_one(spark, sf_dir, tmp_path):
    """Each stage on what the one before kept, against its rule in plain Python or its own operator's promise."""
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, [{r.doc_id: r.text for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        found = {r.doc_id: r.text for r in docs.collect()}
        assert docs.count() == len(found) and found.items() <= kept[-1].items()
        kept.append(found)
    prints = {k: plain_fingerprint(t) for k, t in kept[2].items()}
    near = [(a, b) for a, b in itertools.combinations(sorted(prints), 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    assert set(kept[3]) == set(groups(prints, near).values())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for key, text in kept[3].items():
        n, hit, _ = expected(text, items)
        assert (key in kept[4]) == (not (hit and 20 * len(hit) >= n))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    check_pieces(pieces, kept[4], lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids)


def test_filters_drop_the_bad_and_keep_the_clean(spark):
    """On a table with enough labels to learn from: sf0.001 has eleven toxic ones."""
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    calm = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, sf_dir).select("doc_id").collect()}
    good = {r.doc_id for r in corpus_pipeline.keep_good(spark, docs, sf_dir).select("doc_id").collect()}

    def share(kept, rows):
        found = [r.doc_id in kept for r in rows]
        return sum(found) / len(found)

    assert share(calm, [r for r in labels if r.toxic == 1]) < 0.3
    assert share(calm, [r for r in labels if r.toxic == 0]) > 0.98
    assert share(good, [r for r in labels if r.quality == 0]) < 0.05
    assert share(good, [r for r in labels if r.quality == 1]) > 0.98


def test_run_gives_pieces_of_documents(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns)
    assert out.count() > 0


def test_stages_take_awkward_and_empty_tables(spark, sf_dir):
    for docs in (rows.awkward(spark, score="x", fingerprint="y", items="z"), rows.empty(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns
            assert out.count() <= docs.count()
