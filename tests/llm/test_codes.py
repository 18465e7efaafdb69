import hashlib
import math
import random

import numpy as np
import pytest
from tidewatch.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, key string, n int"


def brute(pairs, parts=16, entries=64, rounds=2):
    """(id, vector, label) rows to (id, code, error, label_error, digest), entry by entry."""
    kept = [(k, [math.floor(256 * x) for x in v], label) for k, v, label in pairs if v and all(x is not None and math.isfinite(x) for x in v)]
    size = len(kept[0][1]) // parts
    cut = [(k, [v[p * size : (p + 1) * size] for p in range(parts)], label) for k, v, label in kept]
    first = sorted(cut, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[row[1][p] for row in first] for p in range(parts)]

    def assign(part, p):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        members = [[[] for _ in first] for _ in range(parts)]
        for _, row, _ in cut:
            for p in range(parts):
                members[p][assign(row[p], p)[1]].append(row[p])
        books = [
            [[sum(c) // len(m) for c in zip(*m)] if m else books[p][i] for i, m in enumerate(members[p])] for p in range(parts)
        ]
    coded = []
    for k, row, label in cut:
        best = [assign(row[p], p) for p in range(parts)]
        coded.append((k, "".join(f"{i:02x}" for _, i in best), sum(d for d, _ in best), label))
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return sorted(((k, c, e, sum(x[2] for x in coded if x[3] == label), digest) for k, c, e, label in coded), key=str)


def table(spark, pairs):
    return spark.createDataFrame([(k, v, label, "x", "y", 1) for k, v, label in pairs], SCHEMA).repartition(4)


def have(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_codes_equal_brute_force_with_ties_and_repeats(spark):
    rng = random.Random(3)
    grid = [i / 8 for i in range(-8, 9)]  # few values: many ties in distance and in sum
    pairs = [(rng.choice([k, k, None]), [rng.choice(grid) for _ in range(32)], rng.choice([0, 1, None])) for k in range(150)]
    pairs += [pairs[5], pairs[5], (3, pairs[9][1], 1)]
    assert have(codes.compress(table(spark, pairs), entries=20)) == brute(pairs, entries=20)


def test_unusable_vectors_and_few_rows(spark):
    good = [(k, [k / 3 + i for i in range(16)], k % 2) for k in range(5)]
    bad = [(-9, None, 1), (-8, [], 1), (-7, [None] * 16, 1), (-6, [1.0] * 15 + [math.nan], 0), (-5, [math.inf] + [1.0] * 15, None)]
    odd = [(7, [1.0] * 17, 1), (8, [1.0] * 32, 1)]
    out = codes.compress(table(spark, good + bad + odd))
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert have(out) == brute(good)
    assert codes.compress(table(spark, bad)).count() == 0
    assert codes.compress(table(spark, [])).count() == 0


def test_components_that_do_not_fit_are_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        codes.compress(table(spark, [(1, [1e30] * 16, 0)])).collect()


def test_search_looks_at_fewer_entries_than_there_are_and_finds_the_nearest():
    rng = np.random.default_rng(0)
    books = rng.integers(-100, 100, (16, 64, 4))
    items = rng.integers(-120, 120, (500, 16, 4))
    index, distance = codes.nearest(items, books)
    every = ((items[:, :, None, :] - books[None]) ** 2).sum(axis=3)
    assert (index == every.argmin(axis=2)).all()
    assert (distance == every.min(axis=2)).all()
    gaps = (items.sum(axis=2)[:, :, None] - books.sum(axis=2)[None]) ** 2
    assert (gaps <= 4 * every.min(axis=2)[:, :, None]).mean() < 0.6  # the share that the bound lets through
