import zlib

import numpy as np
import public_tokenizers
import pytest
import rows
from pyspark.sql import functions as F
from tidewatch.llm import packing, token_files
from tidewatch.llm.tokens import Encoder
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "a", " a", "a ", "a  b", "a \n b", "a\nb c", "a\n\nb c\n", "it's we've don't", "1 22 a3 _x $ %%", "é😀 ü", "a\tb c", "a \tb",
    "x\r\ny z", "a b c", "\0 a", "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y z", "  a b", "\x1f a", "…  —", rows.LONG,
]


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_the_library(spark, sf_dir, plain, monkeypatch):
    monkeypatch.setattr("tidewatch.llm.tokens.PARTS_KEPT", 500)
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    encoder = Encoder(PATH)
    for some in (texts, texts[::-1], [], [""], ["", "a b"]):
        ids, counts = encoder.encode(some)
        assert [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])][: len(some)] == [plain(t) for t in some]


def test_file_set_gives_every_document_back(spark, sf_dir, plain, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(1_000_000 + k, t) for k, t in enumerate(ODD)], "doc_id long, text string")
    both = docs.unionByName(odd).repartition(5).withColumn("frames", F.lit("x"))
    folder = str(tmp_path / "set")
    token_files.write(both, folder, PATH, end_id=2)
    texts = {r.doc_id: r.text for r in both.collect()}
    want, start = {}, 0
    for key in sorted(texts):
        ids = [*plain(texts[key]), 2]
        want[key] = (start, len(ids), crc(ids))
        start += len(ids)
    out = token_files.read_digests(spark, folder).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in out} == want and len(out) == len(want)
    some = token_files.read(spark, folder, keys=[3, 1_000_002, 77_777_777]).collect()
    assert {r.doc_id: r.ids for r in some} == {k: [*plain(texts[k]), 2] for k in (3, 1_000_002)}


def test_file_set_of_awkward_rows_and_of_none(spark, plain, tmp_path):
    token_files.write(rows.awkward(spark, tie="x", tokens="y"), str(tmp_path / "a"), PATH, end_id=2)
    out = token_files.read(spark, str(tmp_path / "a")).orderBy("start").collect()
    assert [r.doc_id for r in out] == sorted((k for k, *_ in rows.DOCS), key=lambda k: -1 if k is None else k)
    assert sorted(r.ids for r in out) == sorted([*plain(t), 2] for _, t, _ in rows.DOCS)
    token_files.write(rows.empty(spark), str(tmp_path / "b"), PATH, end_id=2)
    assert token_files.read_digests(spark, str(tmp_path / "b")).count() == 0


def check_pieces(pieces, texts, plain):
    """Every id of every document in one piece, sequences without gaps and not too long."""
    got = {}
    for r in pieces:
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == set(texts)
    for key, own in got.items():
        ids = [*plain(texts[key]), 1]
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    sequences = {}
    for r in pieces:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    sizes = []
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        sizes.append(at)
    assert max(sizes) <= packing.LENGTH
    return sum(0 if n & (n - 1) == 0 else packing.LENGTH - n for n in sizes) / sum(sizes)


def test_packed_documents(spark, sf_dir, plain):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(4)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert check_pieces(packing.pack(docs, PATH, end_id=1).collect(), texts, plain) < 0.02


def test_packed_awkward_rows_and_none(spark, plain):
    docs = rows.awkward(spark, part="x", offset="y").dropDuplicates(["doc_id", "text"]).where("doc_id IS NOT NULL")
    texts = {r.doc_id: r.text for r in docs.collect()}
    check_pieces(packing.pack(docs, PATH, end_id=1).collect(), texts, plain)
    repeated = packing.pack(rows.awkward(spark), PATH, end_id=1).collect()
    assert sum(r.length for r in repeated) == sum(len(plain(t)) + 1 for _, t, _ in rows.DOCS)
    assert packing.pack(rows.empty(spark), PATH, end_id=1).count() == 0


def least_cost(places, costs, length):
    least = [0]
    for i in range(1, len(places)):
        options = []
        for j in range(i):
            n = places[i] - places[j]
            if n <= length:
                options.append(least[j] + (0 if n >= packing.GRID and n & (n - 1) == 0 else length - n))
        least.append(min(options) + costs[i] + packing.SEQUENCE)
    return least[-1]


def test_cuts_cost_the_least(plain):
    draw = np.random.default_rng(6)
    for _ in range(20):
        ids = draw.integers(2, 9, draw.integers(1, 3000)).astype(np.uint32)
        ends = np.unique(np.append(draw.integers(1, len(ids) + 1, 5), len(ids)))
        places, costs = packing.cuts_of(ids, ends, np.arange(9) == 8)
        cuts = packing.best_cuts(places, costs, 512)
        sizes = np.diff(np.concatenate([[0], cuts]))
        assert sizes.max() <= 512 and cuts[-1] == len(ids)
        padding = sum(0 if n >= packing.GRID and n & (n - 1) == 0 else 512 - n for n in sizes.tolist())
        price = dict(zip(places.tolist(), costs.tolist(), strict=True))
        assert padding + sum(price[c] + packing.SEQUENCE for c in cuts.tolist()) == least_cost(places.tolist(), costs.tolist(), 512)


def test_encoder_keeps_no_offsets(plain):
    """Ids come by the library's call that computes nothing else."""
    encoder = Encoder(PATH)

    class Fast:
        encode_batch_fast = encoder.tokenizer.encode_batch_fast

    encoder.tokenizer = Fast()
    ids, counts = encoder.encode(ODD)
    assert ids.tolist() == [id for text in ODD for id in plain(text)] and counts.tolist() == [len(plain(text)) for text in ODD]
