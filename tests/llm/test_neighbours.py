import itertools

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tidewatch.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, rank string, ids string"


def exact(table, asked, nearest=20):
    out = {}
    for key, vector in table:
        if not asked(key):
            continue
        scores = sorted((-sum(float(a) * float(b) for a, b in zip(vector, v, strict=True)), k) for k, v in table if k != key)
        out[key] = scores[:nearest]
    return out


def searched(spark, table, **options):
    rows = [(k, [float(x) for x in v] if v is not None else None, "r", "i") for k, v in table]
    out = {}
    for r in neighbours.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, **options).collect():
        out.setdefault(r.query_id, []).append((r.rank, -r.score, r.vec_id))
    for found in out.values():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, len(found) + 1))
    return {key: [(score, k) for _, score, k in found] for key, found in out.items()}


@pytest.mark.parametrize(("bits", "axes"), [(3, 2), (2, 3), (1, 4)])
def test_curve_visits_every_place_by_single_steps(bits, axes):
    places = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
    keys = neighbours.hilbert_keys(places, bits)
    assert sorted(keys) == list(range(len(places)))
    assert (np.abs(np.diff(places[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_recall_on_the_given_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    table = [(r.vec_id, np.array(r.embedding)) for r in rows.collect()]
    found = {}
    for r in neighbours.search(rows, F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    ids, vectors = np.array([k for k, _ in table]), np.array([v for _, v in table], float)
    recalls = []
    for i in np.flatnonzero(ids % 20 == 0):
        scores = vectors @ vectors[i]
        scores[i] = -np.inf
        recalls.append(len(set(ids[np.argsort(-scores)[:20]].tolist()) & found[ids[i]]) / 20)
    assert np.mean(recalls) >= 0.9


def test_copies_ties_lengths_and_unusable_vectors(spark):
    draw = np.random.default_rng(2)
    table = [(k, draw.integers(-2, 3, 6).astype(np.float32) * (k % 4 + 1)) for k in range(300)]
    table += [(k, np.ones(6, np.float32)) for k in range(1000, 1200)]
    table = [(k, v) for k, v in table if v.any()]
    bad = [(2000, None), (2020, [0] * 6), (2040, [1, 1, 1, 1, 1, float("nan")]), (2060, [1, 1, 1, 1, 1, float("inf")]), (2080, [1] * 5), (None, [1] * 6)]
    assert searched(spark, [*table, *bad, table[0]]) == exact(table, lambda k: k % 20 == 0)


def test_few_and_no_rows(spark):
    table = [(20, np.array([1.0, 0.0])), (21, np.array([0.0, 1.0])), (22, np.array([-1.0, 0.0]))]
    assert searched(spark, table) == {20: [(0.0, 21), (1.0, 22)]}
    assert searched(spark, table[:1]) == {}
    assert searched(spark, []) == {}


def compared(places, used, reach):
    """Pairs of a query and a row that the search compares, on all its curves."""
    total = 0
    for _, points in places.where(F.col("curve") < used).toPandas().groupby(["curve", "level"]):
        n, asked = int((points.asks == 0).sum()), np.sort(points["at"][points.asks == 1].to_numpy())
        assert sorted(points["at"][points.asks == 0]) == list(range(n))
        for start in range(0, n, neighbours.ROWS):
            size = min(neighbours.ROWS, n - start)
            here = asked[(asked + reach > start) & (asked - reach < start + size)]
            total += sum((last - first) * (high - low) for first, last, low, high in neighbours.windows(here, start, size, reach))
    return total


def recall(spark, tmp_path, monkeypatch, vectors, nearest=20, every=200):
    """Of the true nearest the share found, and the rows compared for each query, as a share of all rows."""
    chosen, reach_of = [], neighbours.reach_of

    def spied(pairs, places, sizes, nearest):
        chosen.append((places, *reach_of(pairs, places, sizes, nearest)))
        return chosen[-1][1:]

    ids = np.arange(len(vectors))
    path = str(tmp_path / f"vectors{len(vectors)}")
    columns = [pa.array(ids), pa.array(list(vectors.astype(np.float32)), pa.list_(pa.float32()))]
    pq.write_table(pa.table(columns, ["vec_id", "embedding"]), path)
    found = {}
    with monkeypatch.context() as patch:
        patch.setattr(neighbours, "reach_of", spied)
        for r in neighbours.search(spark.read.parquet(path), F.col("vec_id") % every == 0, nearest=nearest).collect():
            found.setdefault(r.query_id, set()).add(r.vec_id)
    assert all(len(x) == nearest for x in found.values())
    exact = vectors.astype(np.float32).astype(float)
    recalls = []
    for i in ids[ids % every == 0]:
        scores = exact @ exact[i]
        scores[i] = -np.inf
        recalls.append(len(set(np.argsort(-scores)[:nearest].tolist()) & found[i]) / nearest)
    print("recall", np.mean(recalls), "curves, reach", chosen[0][1:], "share", compared(*chosen[0]) / len(recalls) / len(ids))
    return np.mean(recalls), compared(*chosen[0]) / len(recalls) / len(ids)


def clustered(draw, n, dimensions=32, clusters=200):
    middles = draw.normal(size=(clusters, dimensions)) * 3
    return middles[draw.integers(0, clusters, n)] + draw.normal(size=(n, dimensions)) * 0.5


@pytest.mark.parametrize(
    ("kind", "most"),
    {"plain": 1.0, "clustered": 0.3, "long vector": 0.3, "off centre": 1.0, "hot cluster": 1.0, "uneven lengths": 0.3}.items(),
)
def test_recall_and_share_of_rows_compared(spark, tmp_path, kind, most, monkeypatch):
    draw = np.random.default_rng(5)
    n = 24_000
    vectors = draw.normal(size=(n, 32)) if kind == "plain" else clustered(draw, n)
    if kind == "long vector":
        vectors[7] *= 1000
    elif kind == "off centre":
        vectors += 10
    elif kind == "hot cluster":
        vectors[: n // 2] = draw.normal(size=32) + draw.normal(size=(n // 2, 32)) * 1e-3
        draw.shuffle(vectors)
    elif kind == "uneven lengths":
        vectors *= draw.lognormal(0, 1.5, n)[:, None]
    found, share = recall(spark, tmp_path, monkeypatch, vectors)
    assert found >= 0.9
    assert share <= most


def test_work_of_a_query_hardly_grows_with_the_rows(spark, tmp_path, monkeypatch):
    draw = np.random.default_rng(6)
    shares = {}
    for n in (12_000, 24_000):
        found, share = recall(spark, tmp_path, monkeypatch, clustered(draw, n, clusters=n // 100))
        assert found >= 0.9
        shares[n] = share * n
    assert shares[24_000] < 1.5 * shares[12_000]


def test_many_ties_go_to_the_smaller_ids(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ROWS", 512)
    monkeypatch.setattr(neighbours, "reach_of", lambda *given: (1, 10_000))  # every query meets all rows
    draw = np.random.default_rng(8)
    signs = np.where(draw.random((4000, 32)) < 0.5, -1.0, 1.0)
    table = [(int(k), signs[k]) for k in draw.permutation(len(signs))]
    found = searched(spark, table)
    scores = signs @ signs.T
    tied = 0
    for query, got in found.items():
        wanted = sorted((-scores[query, k], k) for k in range(len(signs)) if k != query)
        tied = max(tied, sum(score <= wanted[19][0] for score, _ in wanted))
        assert got == wanted[:20]
    assert len(found) == 200 and tied > 29


def test_best_of_keeps_the_smaller_numbers_of_many_ties():
    draw = np.random.default_rng(9)
    signs = np.where(draw.random((6000, 24)) < 0.5, -1.0, 1.0)
    numbers = draw.permutation(len(signs))
    query, row, _ = neighbours.best_of(signs[:40], signs, numbers, 21)
    for i in range(40):
        wanted = sorted(zip(-(signs @ signs[i]), numbers, strict=True))[:21]
        assert numbers[row[query == i]].tolist() == [k for _, k in wanted]
