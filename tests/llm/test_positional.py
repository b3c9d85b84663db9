"""The positional index against plain searches."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quire.llm import positional as P

LOW = str.maketrans(P.UPPER, P.LOWER)
DOCS = "doc_id long, text string, n_hit string, row int, wid int"


def words(text):
    return [x for x in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOW)) if x]


def windows(items, size):
    out = {}
    for i, text in items:
        w = words(text)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            out.setdefault(tuple(w[k:k + size]), set()).add(i)
    return out


def brute(docs, items, size):
    asked = windows(items, size)
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in asked}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in asked:
                    hit |= set(range(k, k + n))
                    found |= asked[tuple(w[k:k + n])]
        out.append((i, len(w), len(hit), sorted(str(x) for x in found if x is not None), bool(hit)))
    return sorted(out, key=repr)


def run(spark, docs, items, size):
    d = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], DOCS).repartition(3)
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, tid int")
    out = P.decontaminate(d, b, size)
    assert out.columns == ["doc_id", "row", "wid", "n_words", "n_hit", "items", "contaminated"]
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in out.collect()), key=repr)


@pytest.mark.parametrize("size", [1, 3, 5])
def test_against_a_plain_search(spark, size):
    r = random.Random(size)
    alphabet = ["a", "b", "The", "the", "É", "é", "x1", "東", "rare"]
    text = lambda n: r.choice([" ", "-", ". "]).join(r.choices(alphabet, [9, 9, 9, 9, 3, 3, 2, 2, 1], k=n))
    items = [(k, text(r.randint(1, 12))) for k in range(30)] + [(3, "a b a b a"), (None, "x1 rare x1"), (40, None), (41, ""), (42, " .. "), (3, "a b a b a")]
    docs = [(k, text(r.randint(0, 60))) for k in range(60)] + [(None, "x1 rare x1"), (None, None), (7, ""), (7, ""), (8, " - "), (9, "a " * 20_000 + items[0][1])]
    docs += [(100 + k, "lead " + items[5][1] + " tail") for k in range(40)]
    assert run(spark, docs, items, size) == brute(docs, items, size)


def test_empty_tables(spark):
    docs, items = [(1, "a b c"), (2, None)], [(1, "a b c")]
    assert run(spark, docs, [], 2) == brute(docs, [], 2)
    assert run(spark, [], items, 2) == []
    assert run(spark, docs, [(1, "never seen")], 2) == brute(docs, [], 2)


def test_lists_too_large_to_broadcast(spark, monkeypatch):
    docs = [(k, "one two three four " * 3 + str(k)) for k in range(30)]
    items = [(1, "two three four one"), (2, "four 7")]
    monkeypatch.setattr(P, "small", lambda df, *a, **b: df)
    monkeypatch.setattr(P, "ROWS", 1)
    assert run(spark, docs, items, 3) == brute(docs, items, 3)


def test_index_of_all_words_and_proximity(spark):
    r = random.Random(9)
    docs = [(k, " ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 40)))) for k in range(40)]
    phrase = [("a", "b", "c"), ("h",), ("d", "d", "e"), ("a", "zz")]
    index = P.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    assert index.lists.count() == sum(len(t.split()) for _, t in docs)
    asked = spark.createDataFrame(list(enumerate(map(list, phrase))), "wid long, words array<string>")
    ids = {x["row"]: x["doc"]["doc_id"] for x in index.documents.collect()}
    text = {i: t.split() for i, t in docs}

    exact = {(x["wid"], ids[x["row"]], x["start"]) for x in P.phrase_matches(index, asked).collect()}
    assert exact == {(k, i, s + 1) for k, p in enumerate(phrase) for i, w in text.items() for s in range(len(w)) if tuple(w[s:s + len(p)]) == p}

    count = {t: sum(w.count(t) for w in text.values()) for t in "abcdefgh"}
    order = {x["term"]: x["tid"] for x in index.terms.collect()}
    near = {(x["wid"], ids[x["row"]], x["pos"]) for x in P.proximity_matches(index, asked, 4).collect()}
    want = set()
    for k, p in enumerate(phrase):
        if all(t in count for t in p):
            rare = min(p, key=lambda t: (count[t], order[t]))
            want |= {(k, i, s + 1) for i, w in text.items() for s in range(len(w)) if w[s] == rare and set(p) <= set(w[max(0, s - 4):s + 5])}
    assert near == want and near


def test_no_python_in_the_plan(spark, sf):
    from quire.llm.queries import QUERIES

    plan = QUERIES["op13_positional_index"](spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_only_asked_lists_are_kept(spark):
    docs = spark.createDataFrame([(1, "a b c a"), (2, "c c")], "doc_id long, text string")
    terms = P.number_terms(spark.createDataFrame([("a",), ("zz",)], "term string"))
    index = P.build_index(docs, terms)
    assert sorted(x["pos"] for x in index.lists.collect()) == [1, 4]
    assert sorted(x["n_words"] for x in index.documents.select(F.col("n_words")).collect()) == [2, 4]
