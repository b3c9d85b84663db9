"""The manifest against a plain tree."""

import random
import zlib
from hashlib import sha256

import pytest

from quire.llm import merkle as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, pos int, key string"


def h(*x):
    return sha256("".join(x).encode()).hexdigest()


def plain_leaf(row):
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (row[0], row[1], row[2], row[3], row[4])))


def climb(nodes):
    """Levels of a tree and, for each leaf, the runs it goes through."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def walk(levels, i):
    return [(level[i // 8 ** k // 8 * 8:i // 8 ** k], level[i // 8 ** k + 1:i // 8 ** k // 8 * 8 + 8]) for k, level in enumerate(levels[:-1])]


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    keys = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for k in keys:
        groups[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[k] = climb([plain_leaf(r) for r in groups[k]])
    top = climb([trees[k][-1][0] for k in keys])
    root = top[-1][0] if keys else None
    out = []
    for n, k in enumerate(keys):
        for i, r in enumerate(groups[k]):
            path = walk(trees[k], i) + walk(top, n)
            named = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            low = None if r[4] is None else r[4].translate(str.maketrans(M.UPPER, M.LOWER))
            node = plain_leaf((*r[:4], low)) if named else plain_leaf(r)
            copies = []
            for before, after in path:
                node = h(*before, node, *after)
                copies.append(node)
            proof = [x for before, after in path for x in before + after]
            out.append((r[0], plain_leaf(r), trees[k][-1][0], root, proof, copies, node, node == root))
    return sorted(out, key=repr)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(5)
    out = M.manifest(df, changed={"text": M.lower_ascii()}, where=M.third(), **options)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof", "copies", "folded_root", "verified"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def corpus(seed, sizes):
    r = random.Random(seed)
    rows, i = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            rows.append((i, r.choice(["s", None, "é"]), lang, r.choice([None, 5]), r.choice(["Ab c", "lower", "", None, "É Upper", "X" * 5000])))
            i += 1
    return rows


@pytest.mark.parametrize("sizes", [
    {"en": 700, "de": 65, None: 9, "": 8, "é": 1},
    {"en": 1}, {"en": 8}, {"en": 9}, {"a": 1, "b": 1}, {f"l{k}": 1 + k % 3 for k in range(70)},
])
@pytest.mark.parametrize("height", [1, 3])
def test_against_a_plain_tree(spark, sizes, height):
    rows = corpus(1, sizes)
    assert run(spark, rows, height=height) == brute(rows)


def test_odd_rows(spark):
    rows = corpus(2, {"en": 20}) + [(None, None, None, None, None), (3, "s", "en", 1, "Tie"), (3, "s", "en", 1, "Tie"), (3, "s", "en", 1, "tie"), (None, "s", "en", 1, "Null id")]
    got = run(spark, rows)
    assert [(*x[:4], x[5:]) for x in got] == [(*x[:4], x[5:]) for x in brute(rows)]
    assert run(spark, []) == []


def test_a_version_copies_only_ancestors():
    nodes = [h(str(i)) for i in range(100)]
    tree = M.levels(nodes, True, 8, 3)
    assert [len(x) for x in tree] == [100, 13, 2, 1] == [len(x) for x in climb(nodes)]
    copies = M.copied(h("new"), M.beside(tree, 42, 8))
    again = M.levels([*nodes[:42], h("new"), *nodes[43:]], True, 8, 3)
    changed = [(k, i) for k, level in enumerate(again) for i, x in enumerate(level) if x != tree[k][i]]
    assert changed == [(0, 42), (1, 5), (2, 0), (3, 0)] and copies == [again[k][i] for k, i in changed[1:]]
