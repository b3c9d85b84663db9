"""Quality classifier and licence scan on planted cases."""

import random
from collections import Counter

import numpy as np
import pytest

from quire.llm import licences, quality

DOCS = "doc_id long, text string, lang string, source string, keep int, p double"


def labelled(n, seed):
    """Documents of four kinds of junk and of plain words; about every second one has a label."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["ne", "ra", "ti", "so", "lu"]) for _ in range(r.randint(1, 4)))
    docs, labels, truth = [], [], {}
    for i in range(n):
        ws = [word() for _ in range(r.randint(5, 150))]
        bad = r.random() < 0.2
        kind = r.randrange(4)
        text = " ".join(ws) if not bad else [
            " ".join(w.upper() + "!!" for w in ws), " ".join(w + r.choice(["***", "$$$"]) for w in ws),
            " | ".join(ws), " ".join(w for w in ws[:4] for _ in range(30))][kind]
        docs.append((i, text, "en", f"s{i % 5}", 1, 0.5))
        truth[i] = int(not bad)
        if r.random() < 0.5:
            labels.append((i, truth[i], 0))
    return docs, labels, truth


def test_quality_of_documents_held_out(spark):
    docs, labels, truth = labelled(1500, 1)
    df = spark.createDataFrame(docs, DOCS)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit(df, lab, most_labelled=300, most_pool=300)
    out = quality.score(df, model)
    assert out.columns == ["doc_id", "text", "lang", "source", "p", "content_score", "metadata_score", "quality_score", "keep"]
    seen = {x[0] for x in labels}
    rows = [r for r in out.collect() if r["doc_id"] not in seen]
    right = Counter((truth[r["doc_id"]], r["keep"]) for r in rows)
    assert right[1, True] >= 0.99 * (right[1, True] + right[1, False])
    assert right[0, False] >= 0.97 * (right[0, True] + right[0, False])
    assert all(0 <= r[x] <= 1 for r in rows for x in ("content_score", "metadata_score", "quality_score"))


def test_views_teach_each_other():
    """With eight labels the exchanged rows decide; the first view alone is weak."""
    r = np.random.default_rng(1)
    y = (r.random(2000) < 0.5).astype(float)
    a = np.hstack([y[:, None] * 2 - 1 + 1.2 * r.normal(size=(2000, 1)), r.normal(size=(2000, 30))]).astype(np.float32)
    b = (y[:, None] * 2 - 1 + 0.3 * r.normal(size=(2000, 1))).astype(np.float32)
    label = np.full(2000, np.nan)
    label[:8] = y[:8] = [0, 1, 0, 1, 0, 1, 0, 1]
    a[:8, 0], b[:8, 0] = y[:8] * 2 - 1, y[:8] * 2 - 1
    accuracy = lambda rounds: ((quality.co_train(a, b, label, rounds=rounds).scores(a, b)[0] > 0.5) == y).mean()
    assert accuracy(6) > accuracy(0)
    assert accuracy(6) > 0.75


@pytest.mark.parametrize("kept", [[], [(0, 1, 0), (1, 1, 0)], [(0, None, 0), (None, 1, 0), (99999, 0, 0)]])
def test_no_labels_or_one_class(spark, kept):
    docs, _, _ = labelled(20, 2)
    df = spark.createDataFrame(docs, DOCS)
    model = quality.fit(df, spark.createDataFrame(kept, "doc_id long, quality int, toxic int"))
    assert all(r["keep"] for r in quality.score(df, model).collect())
    assert quality.score(df.limit(0), quality.fit(df.limit(0), spark.createDataFrame([], "doc_id long, quality int"))).count() == 0


def test_odd_rows_are_scored(spark):
    docs, labels, _ = labelled(300, 3)
    odd = [(None, None, None, None, None, None), (1, "", None, "", 0, 0.0), (1, "", None, "", 0, 0.0), (2, "a", "xx", "y" * 500, 1, 1.0), (3, "wörter " * 100_000, "de", "s", 1, 1.0)]
    df = spark.createDataFrame(docs + odd, DOCS)
    model = quality.fit(df, spark.createDataFrame(labels + labels[:3], "doc_id long, quality int, toxic int"), 100, 100)
    out = quality.score(df.drop("lang"), model).collect()
    assert len(out) == 305 and all(r["quality_score"] == r["quality_score"] for r in out)


def test_rows_of_one_id_push_no_other_out(spark):
    docs, labels, _ = labelled(300, 4)
    crowd = [(-1, f"ne ra {i}", "en", "s0", 1, 0.5) for i in range(900)]
    label = spark.createDataFrame([*labels, (-1, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(spark.createDataFrame(docs + crowd, DOCS), label, 200, 200)
    assert model.content is not None  # labels of both classes were seen


def test_rare_class_is_drawn(spark):
    rows = [(i, "ne ra ti so lu " * 9 if i % 500 else "NE!! RA!! TI!!", "en", "s0", 1, 0.5) for i in range(4000)]
    labels = spark.createDataFrame([(r[0], int(r[0] % 500 > 0), 0) for r in rows], "doc_id long, quality int, toxic int")
    for seed in range(3):
        assert quality.fit(spark.createDataFrame(rows, DOCS), labels, 40, 40, seed=seed).content is not None
    assert quality.shares({1.0: 9000, 0.0: 3}, 3000) == {1.0: 2997, 0.0: 3}
    assert quality.shares({1.0: 9000, 0.0: 3000}, 3000) == {1.0: 2250, 0.0: 750}


# ---- licences ---------------------------------------------------------------

NOTICES = {
    "MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL": "This work is licensed under the GNU General Public License, version 3.", "CC-BY-NC": "Licensed under CC BY-NC 4.0.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "LGPL": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "CC-BY-SA": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}
PLAIN = [
    "He showed his licence to the officer at the gate.", "The apache warriors rode north.", "Mit dem Zug nach Berlin.",
    "All rights of way were closed.", "A creative person with common sense.", "The gnu is an antelope.", "No warranty repairs today.",
]


def test_notices_are_found_and_mentions_are_not(spark):
    r = random.Random(1)
    filler = lambda: " ".join(r.choice(["the", "nera", "tisolu", "and", "of", "lune"]) for _ in range(r.randint(3, 25)))
    rows, want = [], set()
    for i in range(300):
        lines = [filler() for _ in range(r.randint(1, 6))]
        if i % 3 == 0:
            family = r.choice(list(NOTICES))
            at = r.randint(0, len(lines))
            lines.insert(at, NOTICES[family])
            want.add((i, at, family))
        elif i % 3 == 1:
            lines.insert(r.randint(0, len(lines)), r.choice(PLAIN))
        rows.append((i, "\n".join(lines), "x", 0.1))
    rows += [(None, NOTICES["MIT"], "x", 0.1), (900, None, "", 0.0), (901, "", "", 0.0), (902, "\n\n", "", 0.0), (903, NOTICES["GPL"] + "\n" + "w " * 100_000, "", 0.0)]
    rows += [(904, NOTICES["MIT"], "", 0.0)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, family string, probability double")
    out = licences.scan(df, licences.train(df, most_negatives=200)).collect()
    got = Counter((r["doc_id"], r["paragraph"], r["family"]) for r in out if r["confirmed"])
    assert got == Counter([*want, (None, 0, "MIT"), (903, 0, "GPL"), (904, 0, "MIT"), (904, 0, "MIT")])
    assert all(0.5 <= r["probability"] <= 1 for r in out)


def test_no_documents(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert licences.scan(df, licences.train(df)).count() == 0


def test_scan_runs_without_python_or_shuffle(spark):
    df = spark.createDataFrame([(1, NOTICES["MIT"])], "doc_id long, text string")
    plan = licences.scan(df, licences.train(df))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Python", "Arrow", "Pandas"))


def test_planted_notices_of_the_test_tables(spark, sf):
    from quire.llm.queries import QUERIES

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {(d["doc_id"], i, f) for d in docs for i, line in enumerate(d["text"].split("\n")) for f, x in NOTICES.items() if x in line}
    assert {(r["doc_id"], r["paragraph"], r["family"]) for r in QUERIES["op10_licence_scan"](spark, sf).collect()} == want
