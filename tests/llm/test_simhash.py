import itertools

import rows
import xxhash
from tidewatch.llm import simhash
from tidewatch.llm.components import components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def groups(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, 500 + i) for i in range(1, 40)]
    links = [*chain, *star, (7, 7), (9, 8), (8, 9), (9, 8), (1, 160)]
    table = spark.createDataFrame([*links, (None, 3)], "a long, b long")
    out = {r.node: r.root for r in components(table).collect()}
    nodes = {n for link in links for n in link}
    want = groups(nodes, links)
    assert set(out) == nodes
    assert {frozenset(n for n in nodes if out[n] == r) for r in set(out.values())} == {
        frozenset(n for n in nodes if want[n] == r) for r in set(want.values())
    }
    assert components(table.limit(0)).count() == 0


def test_near_duplicates_equal_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    prints = {k: plain_fingerprint(t) for k, t in texts.items()}
    want = groups(prints, [(a, b) for a, b in itertools.combinations(sorted(prints), 2) if (prints[a] ^ prints[b]).bit_count() <= 2])
    out = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert {k: int(r.fingerprint, 16) for k, r in out.items()} == prints
    assert {k: r.component_id for k, r in out.items()} == want
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_links_connect_every_pair_within_two_bits(spark):
    values = [0, 1, 3, 7, 15, 1 << 63, (1 << 63) | 1, 0xFF00, 0xFF03, -1]
    out = simhash.links(spark.createDataFrame([(v if v < 1 << 63 else v - (1 << 64),) for v in values], "fingerprint long"))
    found = {(r.a, r.b) for r in out.collect()}
    signed = [v if v < 1 << 63 else v - (1 << 64) for v in values]
    near = [(a, b) for a, b in itertools.combinations(sorted(signed), 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    assert groups(signed, found) == groups(signed, near)


def test_awkward_rows_and_empty_tables(spark):
    docs = rows.awkward(spark, fingerprint="x", component_id="y", root="z")
    out = simhash.near_duplicates(docs).collect()
    assert len(out) == len(rows.DOCS)
    assert {r.component_id for r in out if r.fingerprint == "0" * 16} == {2}
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 5, 7]
    assert simhash.near_duplicates(rows.empty(spark)).count() == 0
    assert simhash.keep_first(rows.empty(spark)).count() == 0
    nameless = simhash.near_duplicates(docs.where("doc_id IS NULL")).collect()
    assert [r.component_id for r in nameless] == [None, None]
