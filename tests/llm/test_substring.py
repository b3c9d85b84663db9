"""Substring dedup against brute force."""

import hashlib
import random

import pyarrow as pa
import pytest

from quire.llm import substring, words


def brute(rows, window):
    tokens = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, ws in tokens:
        if i is not None:
            for k in range(len(ws) - window + 1):
                g = tuple(ws[k:k + window])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, ws in tokens:
        gone = set()
        if i is not None:
            for k in range(len(ws) - window + 1):
                if first[tuple(ws[k:k + window])] < i:
                    gone |= set(range(k, k + window))
        kept = b" ".join(w for k, w in enumerate(ws) if k not in gone).decode()
        spans = [k for k in sorted(gone) if k - 1 not in gone], [k + 1 for k in sorted(gone) if k + 1 not in gone]
        out.append((i, kept, len(ws), len(gone), tuple(zip(*spans, strict=True))))
    return sorted(out, key=repr)


def run(df, **kw):
    rows = substring.substring_dedup(df, **kw).collect()
    return sorted(
        ((r["doc_id"], r["kept"], r["n_words"], r["n_removed"], tuple((s["start"], s["end"]) for s in r["repeats"])) for r in rows),
        key=repr)


def texts(seed, n, vocabulary, longest):
    r = random.Random(seed)
    pool = ["".join(r.choice("abcé ") for _ in range(r.randint(1, 4))) for _ in range(vocabulary)]
    out = []
    for _ in range(n):
        ws = [r.choice(pool) for _ in range(r.randint(0, longest))]
        if out and r.random() < 0.6:
            other = (r.choice(out) or "").split()
            a = r.randint(0, len(other))
            ws[r.randint(0, len(ws)):0] = other[a:a + r.randint(0, 40)]
        out.append(r.choice([" ", "\n", "\t\x0b "]).join(ws))
    return out


@pytest.mark.parametrize("seed,window,seedlen,vocabulary", [(1, 13, 6, 300), (2, 5, 2, 6), (3, 13, 13, 40), (4, 3, 1, 4), (5, 8, 3, 2)])
def test_random_texts(spark, seed, window, seedlen, vocabulary):
    found = texts(seed, 150, vocabulary, 80)
    ids = list(range(-40, 110))
    random.Random(seed).shuffle(ids)
    rows = list(zip(ids, found, strict=True)) + [(500, None), (501, ""), (None, found[0]), (None, found[0]), (502, found[3]), (503, found[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert run(df, window=window, seed=seedlen) == brute(rows, window)


def test_repeated_ids_long_texts_and_other_columns(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    a = " ".join(f"a{i}" for i in range(30))
    rows = [(1, a, 1, "x"), (1, a, 1, "x"), (1, "z " + a, 1, None), (2, a + " end", 2, "x"), (3, long, 3, "x"), (4, "q " + long, 4, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int, kept string")
    assert run(df) == brute([r[:2] for r in rows], 13)
    out = substring.substring_dedup(df)
    assert out.columns == ["doc_id", "text", "part", "kept", "n_words", "n_removed", "repeats"]
    assert {(r["text"], r["part"]) for r in out.collect()} == {(r[1], r[2]) for r in rows}
    assert substring.substring_dedup(df.limit(0)).count() == 0


def test_common_passage_is_one_entry_a_task(spark):
    """A passage in every document weighs one packed entry per task, not one per document."""
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(i, f"h{i} {passage} t{i}") for i in range(400)]
    got = run(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert got == brute(rows, 13)


def test_word_hashes_follow_the_words():
    r = random.Random(3)
    found = [None if r.random() < 0.1 else "".join(r.choice("ab é\n\t c\x0b") for _ in range(r.randint(0, 40))) for _ in range(400)]
    value, row = words.hashed_words(pa.array(found)[5:])
    plain = [(w, i) for i, t in enumerate(found[5:]) for w in (t or "").encode().split()]
    assert row.tolist() == [i for _, i in plain]
    names = {}
    assert all(names.setdefault(w, x) == x for (w, _), x in zip(plain, value.tolist(), strict=True))
    assert len(set(names.values())) == len(names)


def test_query_columns(spark, sf):
    from quire.llm.queries import QUERIES

    row = QUERIES["op9_seed_and_extend"](spark, sf).where("n_removed = 0").first()
    text = spark.read.parquet(f"{sf}/documents.parquet").where(f"doc_id = {row['doc_id']}").first()["text"]
    assert row["kept_sha256"] == hashlib.sha256(b" ".join(text.encode().split())).hexdigest()
