"""Python stages go through Arrow batches of any size in parts of bounded size."""

import random
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.functions import encoding
from quire.functions import text as T
from quire.functions.arrow import by_bytes
from quire.operators import retrieval as R


def test_parts_of_a_batch():
    r = random.Random(1)
    texts = pa.array([None if r.random() < 0.1 else "é" * r.randint(0, 90) for _ in range(500)] + ["x" * 5000])
    for batch in (texts, texts.slice(37), texts.slice(0, 0)):
        parts = list(by_bytes(batch, 700, 9))
        assert pa.concat_arrays([*parts, batch.slice(0, 0)]).equals(batch)
        assert all(len(p) == 1 or len(p) <= 9 and sum(len((x or "").encode()) for x in p.to_pylist()) <= 700 for p in parts)


def test_normalization_holds_a_part_at_a_time():
    texts = ["ﬁne ²" + "é" * 2000, None, ""] * 1500
    parts = list(T._nfkc.func(iter([pa.array(texts)])))
    assert pa.concat_arrays(parts).to_pylist() == [x and normalize("NFKC", x) for x in texts]
    assert len(parts) > 5 and max(len(p) for p in parts) <= 1024 and max(p.nbytes for p in parts) < 2 << 20


class Measured(encoding.HashingEncoder):
    def encode(self, texts):
        assert len(texts) <= 1024 and sum(len(x or "") for x in texts) <= 1 << 20
        return super().encode(texts)


@pytest.fixture
def large_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "10000")
    yield spark
    spark.conf.set(name, before)


def test_encoder_gets_a_part_at_a_time(large_batches):
    text = F.when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.repeat(F.concat(F.lit("w"), F.col("id"), F.lit(" ")), 100))
    df = large_batches.range(0, 3000, 1, 1).select("id", text.alias("embed_text"))
    got = {r["id"]: (r["terms"], r["weights"]) for r in encoding.embed(df, encoder=Measured()).collect()}
    assert got == {i: ([encoding.term_id(f"w{i}")], [100.0]) if i % 7 else ([], []) for i in range(3000)}


def test_sparse_scores_are_made_in_parts(spark, monkeypatch):
    """However many queries share terms with a batch, the shared terms at once are bounded, and scores are whole."""
    r = random.Random(4)
    vec = lambda n: sorted(r.sample(range(40), n))
    rows = [{"qid": q, "dense": [1.0, float(q)], "terms": vec(10), "weights": [float(r.randint(1, 9)) for _ in range(10)]} for q in range(50)]
    points = [(i, [float(r.randint(-5, 5)) for _ in range(2)], vec(r.choice((0, 5, 20)))) for i in range(400)]
    monkeypatch.setattr(R, "MATCHES", 500)
    monkeypatch.setattr(R, "POINTS", 64)
    block = R.QueryBlock(rows)
    at = np.repeat(np.arange(400), [len(p[2]) for p in points])
    terms = np.array([t for p in points for t in p[2]])
    cuts = list(block.parts(at, terms))
    assert cuts[0].start == 0 and cuts[-1].stop == len(at) and all(a.stop == b.start for a, b in zip(cuts, cuts[1:]))
    most = 0
    for s in cuts:
        assert s.start == 0 or at[s.start] != at[s.start - 1]
        most = max(most, sum(int((block.terms == t).sum()) for t in terms[s]) if len(set(at[s])) > 1 else 0)
    assert 0 < most <= 500

    frame = spark.createDataFrame([(i, d, t, [2.0] * len(t)) for i, d, t in points], "id long, dense array<float>, terms array<long>, weights array<float>").coalesce(1)
    asked = spark.createDataFrame([(x["qid"], x["dense"], x["terms"], x["weights"]) for x in rows], "qid long, dense array<float>, terms array<long>, weights array<float>")
    small = {tuple(x) for x in R.nearest(frame, asked, 7).collect()}
    want = set()
    for x in rows:
        weight = dict(zip(x["terms"], x["weights"], strict=True))
        scored = sorted((-sum(2 * weight.get(t, 0) for t in ts), i) for i, _, ts in points)
        want |= {("sparse", x["qid"], i, -s, k + 1) for k, (s, i) in enumerate(scored[:7]) if s < 0}
    assert {x for x in small if x[0] == "sparse"} == want
