"""The near-copy stage of the pipeline against brute-force Jaccard similarity."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from quire.llm import shared_shingles
from quire.llm.shared_shingles import band_keys, shingles
from quire.llm.simhash import near_matrix, signature


def plain_set(text):
    words = (text or "").encode().lower().split()
    n = min(5, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if words else {()}


def plain_kept(rows):
    """Ids left by brute force over all pairs; ids are unique."""
    sets = {i: plain_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if j < i and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i for i in ids if root[i] == i}


def frame(spark, rows):
    return spark.createDataFrame(
        [(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def planted(seed=5):
    """Texts with copies of which some words are changed: similarities from 0.5 to 1; chains and a crowd."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    rows = []
    for _ in range(60):
        base = [word() for _ in range(rng.choice((3, 5, 12, 60, 250)))]
        rows.append(base)
        for changed in (0, 1, 2, 4, 7):
            copy = list(base)
            for _ in range(min(changed, len(base) - 1)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(copy)
    base = [word() for _ in range(100)]
    for _ in range(300):  # more than a chunk
        base = list(base) if rng.random() < 0.9 else [word() for _ in range(100)]
        base[rng.randrange(100)] = word()
        rows.append(base)
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    return [(i, " ".join(x)) for i, x in zip(ids, rows, strict=True)] + [(9001, ""), (9000, None), (9002, " \n")]


def test_against_brute_force(spark, sf):
    rows = planted()
    got = [r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, frame(spark, rows), sf).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_kept(rows)


def test_documents_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, sf).collect()} == plain_kept(rows)


def test_repeated_id_with_other_text(spark, sf):
    a, b = (" ".join(f"{x}{i}" for i in range(50)) for x in "ab")
    got = corpus_pipeline.drop_near_copies(spark, frame(spark, [(1, a), (1, b), (1, b), (2, b)]), sf).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(1, a), (1, b)]


def test_slices_of_a_batch():
    texts = pa.array([t for _, t in planted()])
    whole = band_keys(texts, 5)
    for a, b in ((0, 7), (7, 300), (300, len(texts)), (len(texts) - 1, len(texts))):
        assert np.array_equal(band_keys(texts.slice(a, b - a), 5), whole[a:b])
    found, at = shingles(texts.slice(5), 5)
    assert len(found) == sum(max(1, len(t.split()) - 4) for t in texts.slice(5).to_pylist() if t and t.split())
    assert np.all(np.diff(at) >= 0)


@pytest.mark.parametrize("n", [500, 1000, 2000])
def test_links_of_a_crowd_are_about_as_many_as_its_texts(spark, monkeypatch, n):
    rng = random.Random(n)
    base = [f"w{rng.randrange(3000)}" for _ in range(100)]
    rows = []
    for i in range(n):
        copy = list(base)
        copy[rng.randrange(100)] = f"x{i}"
        rows.append((i, " ".join(copy), "en", "s", 1))
    made, whole = [], shared_shingles.class_links

    def counted(*args):
        links = whole(*args)
        made.append(links.count())
        return links

    monkeypatch.setattr(shared_shingles, "class_links", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["doc_id"] for r in shared_shingles.near_copies(df).where("stays").collect()] == [0]
    assert sum(made) <= 2 * n, made


def test_chunks_of_a_crowd_meet(spark, sf, monkeypatch):
    """With one text to a chunk everything but equal keys has to be found across chunks."""
    whole = shared_shingles.node_classes
    monkeypatch.setattr(shared_shingles, "node_classes", lambda *a: whole(*a, shard=2, most_bytes=1000))
    rows = planted(8)[:200]
    got = [r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, frame(spark, rows), sf).collect()]
    assert set(got) == plain_kept(rows)


def test_candidates_come_from_the_trees(spark, sf, monkeypatch):
    """Pairs of similarity 0.8 are within the radius, and what the trees do not find is not linked."""
    rng = np.random.default_rng(3)
    for n in (4, 8, 40, 400):
        for _ in range(300):
            x = rng.integers(0, 1 << 64, n + n // 4, np.uint64)
            a, b = signature(x[:n]), signature(x)
            assert ((a ^ b) & (1 << 64) - 1).bit_count() <= shared_shingles.RADIUS
    values = rng.integers(0, 1 << 64, 90, np.uint64)
    near = near_matrix(np.concatenate([values, values[:9]]).view(np.int64), 28)
    both = np.concatenate([values, values[:9]]).tolist()
    assert near.tolist() == [[(a ^ b).bit_count() <= 28 for b in both] for a in both]

    asked = []

    def none(prints, radius):
        asked.append(len(prints))
        return np.zeros((len(prints), len(prints)), bool)

    sets = [np.arange(9, dtype=np.uint64), np.arange(10, dtype=np.uint64)]
    prints, classes = np.array([signature(x) for x in sets]), np.array([0, 1])
    assert shared_shingles.near_classes(sets, prints, classes, 0.8) == {(0, 1)}
    monkeypatch.setattr(shared_shingles, "near_matrix", none)
    assert shared_shingles.near_classes(sets, prints, classes, 0.8) == set() and asked == [2]
