"""Model stages: loading, batches, limits, and the results of the built-in encoder and scorer."""

import re
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from checks import queries as Q
from quire.functions import encoding
from quire.functions.models import ModelEncoder, by_length, cut_words, model_scorer
from quire.operators import retrieval as R


class Watched(encoding.HashingEncoder):
    """Leaves a mark for every load and for every batch."""

    def __init__(self, folder):
        super().__init__()
        self.folder = Path(folder)
        (self.folder / f"load-{uuid.uuid4().hex}").touch()

    def encode(self, texts):
        (self.folder / f"batch-{uuid.uuid4().hex}").write_text(",".join(str(len(x)) for x in texts))
        return super().encode(texts)


def test_batches_of_like_length(spark, tmp_path):
    folder = str(tmp_path)
    texts = [(i, "w " * ((i * 37) % 101)) for i in range(200)] + [(500, None)]
    df = spark.createDataFrame(texts, "id bigint, embed_text string").coalesce(1)
    one = {r["id"]: r for r in encoding.embed(df, encoder=ModelEncoder(lambda: Watched(folder), batch=8)).collect()}
    assert len(list(tmp_path.glob("load-*"))) == 1
    batches = [[int(x) for x in p.read_text().split(",")] for p in tmp_path.glob("batch-*")]
    assert sum(map(len, batches)) == 201 and max(map(len, batches)) == 8
    spans = sorted((min(b), max(b)) for b in batches)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    other = {r["id"]: r for r in encoding.embed(df.orderBy(F.rand(3)).repartition(5), encoder=ModelEncoder(lambda: Watched(folder), batch=3)).collect()}
    assert one == other
    plain = {r["id"]: r for r in encoding.embed(df).collect()}
    assert {i: (r["dense"], sorted(zip(r["terms"], r["weights"]))) for i, r in one.items()} == {
        i: (r["dense"], sorted(zip(r["terms"], r["weights"]))) for i, r in plain.items()}


def test_token_limit(spark):
    df = spark.createDataFrame([(1, "a b\n c d"), (2, "a"), (3, "")], "id bigint, embed_text string")
    limited = encoding.embed(df, encoder=ModelEncoder(encoding.HashingEncoder, most_tokens=2))
    cut = df.withColumn("embed_text", F.when(F.col("id") == 1, "a b").otherwise(F.col("embed_text")))
    assert sorted(limited.collect()) == sorted(encoding.embed(cut).collect())
    assert [cut_words(x, 2) for x in ("a b c", " a  b ", "a", "", "  ")] == ["a b", " a  b", "a", "", "  "]
    assert [x.tolist() for x in by_length([3, 1, 2, 1], 3)] == [[1, 3, 2], [0]]


class Overlap:
    """The share of the query's words that the text holds, as the built-in scorer has it."""

    def score(self, pairs):
        words = lambda x: set(re.findall(r"\w+", x.lower()))
        return [len(words(q) & words(t)) / max(1, len(words(q))) for q, t in pairs]


def test_model_stages_give_the_results_of_the_queries(spark, sf, monkeypatch):
    want = sorted(map(tuple, Q.QUERIES["embed_points"](spark, sf).collect()))
    monkeypatch.setattr(Q, "embed", lambda df: encoding.embed(df, encoder=ModelEncoder(encoding.HashingEncoder)))
    assert sorted(map(tuple, Q.QUERIES["embed_points"](spark, sf).collect())) == want
    hits = spark.createDataFrame(
        [(q, f"alpha beta q{q}", i, f"{'alpha ' * (i % 3)} {'beta' * (i % 2)} q{i % 4}", i + 1) for q in range(3) for i in range(12)],
        "qid bigint, query string, id bigint, text string, rank int")
    got = R.rerank(hits, 5, model_scorer(Overlap, batch=4)).select("qid", "id", "rank", F.round("rerank_score", 9))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, R.rerank(hits, 5).select("qid", "id", "rank", F.round("rerank_score", 9)).collect()))


def test_encoder_may_stand_in_a_search(spark):
    points = encoding.embed(spark.createDataFrame([(1, "red fox", "b", None, None), (2, "blue whale", "b", None, None)], "id bigint, text string, book string, kind string, source string"), "text")
    asked = spark.createDataFrame([(9, "whale")], "qid bigint, text string")
    got = R.encode_queries(asked, ModelEncoder(encoding.HashingEncoder)).first()
    assert np.allclose(got["dense"], R.encode_queries(asked).first()["dense"]) and points.count() == 2
