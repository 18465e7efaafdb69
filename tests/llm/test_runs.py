import hashlib
import random
import re
import zlib

import numpy as np
import rows
from tidewatch.llm import queries, runs


def brute(words):
    """All runs by comparing all words at every period; of periods of one stretch the smallest."""
    numbers = {}
    ids = np.array([numbers.setdefault(word, len(numbers)) for word in words], np.int64)
    n, found = len(ids), []
    for q in range(1, n // 4 + 1):
        same = np.concatenate([[0], ids[q:] == ids[: n - q], [0]]).astype(int)
        steps = np.diff(same)
        for begin, end in zip(np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)):
            length = int(end - begin) + q
            inside = any(s <= begin and begin + length <= s + m for s, m, d in found if q % d == 0)
            if length >= max(6, 4 * q) and not inside:
                found.append((int(begin), length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def digests(key, text):
    """The query's columns by the rule itself."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(key).encode())
    if h % 10 == 0 and n and key is not None:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [word if i < a else words[a + (i - a) % p] for i, word in enumerate(words)]
    found = brute(words)
    kept = [True] * n
    for s, m, q in found:
        kept[s + q : s + m] = [False] * (m - q)
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    rest = " ".join(word for word, keep in zip(words, kept) if keep)
    milli = 1000 * best[1] // best[2] if found else None
    return (key, len(found), *best, milli, *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, rest)))


def made(seed, letters):
    rng = random.Random(seed)
    out, n = [], rng.randint(0, 200)
    while len(out) < n:
        part = [rng.randrange(letters) for _ in range(rng.randint(1, 20))]
        out += part * rng.choice([1, 1, 2, 3, 4, 5, 9]) + part[: rng.randint(0, len(part))]
    return out[:n]


def test_runs_equal_brute_force_on_repetitive_texts():
    for seed in range(400):
        texts = [made(seed * 7 + k, 1 + (seed + k) % 5) for k in range(3)]
        found = runs.find_runs([np.array(text, np.int64) for text in texts])
        assert found == [brute(text) for text in texts], texts


def test_long_texts_of_every_period():
    for period in (1, 2, 3, 7, 8, 9, 255, 256, 257, 2500):
        part = list(range(period))
        text = [-3, -2, *(part * (20_000 // period)), -1, *part]
        text = [x + 3 for x in text]
        assert runs.find_runs([np.array(text, np.int64)]) == [[(2, period * (20_000 // period), period)]]


def test_one_word_over_and_over_with_breaks():
    text = ([1] * 3000 + [2]) * 40
    found = runs.find_runs([np.array(text, np.int64)])[0]
    assert found == sorted([(i * 3001, 3000, 1) for i in range(40)] + [(0, 40 * 3001, 3001)], key=lambda r: (r[0], r[2]))


def test_query_equals_the_rule(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = sorted(digests(r.doc_id, r.text) for r in docs)
    out = queries.QUERIES["op12_periodic_runs"](spark, sf_dir)
    assert ", ".join(f"{c} {kind}" for c, kind in out.dtypes) == (
        "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
        "runs_sha256 string, collapsed_sha256 string"
    )
    assert sorted(tuple(r) for r in out.collect()) == want
    assert sum(row[1] for row in want) > 5


def test_awkward_rows_and_empty_tables(spark):
    docs = rows.awkward(spark, runs="x", n_words="y", collapsed="z", body="b", length="w")
    out = {(r.doc_id, r.n_words): r for r in runs.periodic_runs(docs).collect()}
    texts = {(r.doc_id, len((r.text or "").encode().split())): r.text for r in docs.collect()}
    assert set(out) == set(texts)
    for at, text in texts.items():
        words = (text or "").encode().split()
        found = brute(words)
        assert [tuple(r) for r in out[at].runs] == found
        assert out[at].collapsed.encode() == b" ".join(runs.collapsed(words, found))
    assert out[5, 28000].runs[0].period == 7
    assert runs.periodic_runs(rows.empty(spark)).count() == 0
