"""Fingerprints and near-duplicate classes against brute force."""

import random

import pytest
import xxhash

from quire.llm import simhash
from quire.llm.components import components


def plain_print(text, n=3):
    words = [w for w in "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in text or "").encode().split()]
    shingles = [b" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(items, radius):
    """items: (id, fingerprint); component of each by flooding."""
    parent = {i: i for i, _ in items}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in items:
        for j, b in items:
            if (a ^ b).bit_count() <= radius:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in items}


def texts(seed, n):
    r = random.Random(seed)
    words = ["Ärger", "THE", "of", "x", "é", "Zoo", " ", "cat", " y"]
    base = [" ".join(r.choice(words) + str(r.randint(0, 30)) for _ in range(r.randint(0, 120))) for _ in range(n)]
    out = []
    for t in base:
        out.append(t)
        parts = t.split(" ")
        for _ in range(r.randint(0, 3)):
            parts[r.randrange(len(parts))] = r.choice(words)
            out.append("\t".join(parts) if r.random() < 0.3 else " ".join(parts))
    return out + ["", None, " \n", "one", "One two", "one\u000btwo", "a" * 5000 + " b" * 40000]


def test_near_duplicates(spark):
    data = [(i, t, i % 7, "k") for i, t in enumerate(texts(1, 120))]
    df = spark.createDataFrame(data, "doc_id long, text string, fp int, component_id string")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    prints = {i: plain_print(t) for i, t, *_ in data}
    want = plain_classes(list(prints.items()), 3)
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


def test_null_ids_repeated_rows_and_no_rows(spark):
    long = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(7, long), (7, long), (3, long), (None, long), (None, "nobody else has this text at all"), (7, other), (9, other)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(False, 3, 3)] + [(False, 7, 3)] * 3 + [(False, 9, 3), (True, 0, 3), (True, 0, None)], key=repr)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 3, 5])
def test_tree_finds_what_a_scan_finds(radius):
    r = random.Random(radius)
    values = list({r.getrandbits(64) for _ in range(60)})
    values = list({v ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 4))) & (1 << 64) - 1 for v in values for _ in range(5)})
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for v in values[:80]:
        assert sorted(tree.within(v, radius)) == [i for i, x in enumerate(values) if (x ^ v).bit_count() <= radius]


def test_crowded_shards_are_split_without_losing_links(spark):
    r = random.Random(5)
    centre, values = r.getrandbits(64), set()
    while len(values) < 150:  # all share most bands
        values.add(centre ^ sum(1 << b for b in r.sample(range(24), r.randint(0, 5))))
    values = [v - (1 << 64) if v >> 63 else v for v in values]
    reps = spark.createDataFrame(list(enumerate(values)), "rep long, fp long")
    want = plain_classes([(i, v & (1 << 64) - 1) for i, v in enumerate(values)], 3)
    for shard in (8, 40, 2048):
        links = simhash.near_links(reps, 3, shard=shard, bucket=50)
        found = {x["node"]: x["component"] for x in components(links).collect()}
        assert {i: found.get(i, i) for i in want} == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 200), (None, 3), (300, 301)]
    r = random.Random(2)
    edges = [(b, a) if r.random() < 0.5 else (a, b) for a, b in edges]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
