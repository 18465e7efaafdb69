import random
import re

import numpy as np
import pytest
import rows
from pyspark.sql import functions as F
from tidewatch.llm import decontaminate
from tidewatch.llm.fm_index import FmIndex, Wavelet

PATTERN = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return PATTERN.findall(lower)


def expected(text, items, window=13):
    own = words(text)
    hit, found = set(), set()
    for item, item_text in items:
        wanted = words(item_text)
        size = min(window, len(wanted))
        for start in range(len(wanted) - size + 1 if size else 0):
            phrase = wanted[start : start + size]
            for at in range(len(own) - size + 1):
                if own[at : at + size] == phrase:
                    hit.update(range(at, at + size))
                    found.add(str(item))
    return len(own), hit, sorted(found)


def test_index_finds_and_places_every_occurrence():
    draw = np.random.default_rng(3)
    symbols = np.append(draw.integers(0, 4, 500), 0)
    index = FmIndex(symbols, 4)
    patterns = np.array([[a, b, c] for a in range(1, 4) for b in range(1, 4) for c in range(1, 4)])
    found, low, high = index.search(patterns)
    for number, a, b in zip(found, low, high, strict=True):
        places = sorted(index.locate(np.arange(a, b)).tolist())
        assert places == [i for i in range(499) if symbols[i : i + 3].tolist() == patterns[number].tolist()]
    assert len(found) == len({tuple(symbols[i : i + 3]) for i in range(499) if 0 not in symbols[i : i + 3]})


def test_wavelet_ranks():
    symbols = np.random.default_rng(1).integers(0, 11, 300)
    wavelet = Wavelet(symbols, 11)
    for symbol in range(11):
        places = np.arange(0, 301, 7)
        assert wavelet.rank(np.full(len(places), symbol), places).tolist() == [
            int((symbols[:i] == symbol).sum()) for i in places
        ]
    got, before = wavelet.access(np.arange(300))
    assert (got == symbols).all()
    assert before.tolist() == [int((symbols[:i] == symbols[i]).sum()) for i in range(300)]


@pytest.mark.parametrize("block_words", [2_000_000, 40])
def test_report_equals_search_by_words(spark, block_words):
    draw = random.Random(5)
    vocabulary = ["the", "of", "Über", "lamp", "42", "é"]
    items = [(k, " ".join(draw.choices(vocabulary, k=draw.choice([3, 13, 20])))) for k in range(8)] + [(8, ""), (8, None), (None, "the of lamp 42")]
    texts = [" ".join(draw.choices(vocabulary, k=60)) for _ in range(30)]
    texts += [f"{t} {items[k % 8][1].upper()}, {t}" for k, t in enumerate(texts)] + [rows.LONG, "", None, "the", items[0][1]]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, spans string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    given = [("null" if k is None else k, t) for k, t in items]
    got = {r.doc_id: r for r in decontaminate.report(docs, bench, block_words=block_words).withColumn("sha", F.lit("")).collect()}
    assert len(got) == len(texts)
    import hashlib

    for k, text in enumerate(texts):
        n, hit, found = expected(text, given)
        row = got[k]
        assert (row.n_words, row.n_hit, row.n_items) == (n, len(hit), len(found))
        assert row.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
        assert row.contaminated == (len(hit) > 0 and 20 * len(hit) >= n)
        assert {i for s in row.spans for i in range(s.first, s.behind)} == hit
        assert all(a.behind < b.first for a, b in zip(row.spans, row.spans[1:], strict=False))


def test_documents_go_or_lose_their_spans(spark):
    phrase = " ".join(f"w{i}" for i in range(15))
    docs = spark.createDataFrame(
        [(1, f"Before, {phrase}! After.", "k"), (2, "clean text", "k"), (3, None, "k"), (None, "", "k")],
        "doc_id long, text string, items string",
    )
    bench = spark.createDataFrame([(0, phrase)], "item_id long, text string")
    left = decontaminate.decontaminate(docs, bench)
    assert left.columns == docs.columns
    assert [(r.doc_id, r.text) for r in left.collect()] == [(2, "clean text"), (3, None), (None, "")]
    cut = decontaminate.decontaminate(docs, bench, cut=True).collect()
    assert [r.text for r in cut] == ["Before, ! After.", "clean text", None, ""]


def test_awkward_rows_and_empty_tables(spark):
    bench = spark.createDataFrame([(1, "plain text of some"), (1, "plain text of some")], "item_id long, text string")
    docs = rows.awkward(spark, n_words="x", spans="y")
    got = decontaminate.report(docs, bench).collect()
    assert len(got) == len(rows.DOCS)
    assert sorted(r.doc_id for r in got if r.n_hit) == [1, 6]
    assert decontaminate.report(rows.empty(spark), bench).count() == 0
    nothing = decontaminate.report(docs, bench.limit(0)).collect()
    assert len(nothing) == len(rows.DOCS) and not any(r.n_hit for r in nothing)
