"""The registered queries against their SQL, and the stages against brute force."""

import pytest

import corpus_pipeline
from checks.compare import database, table, type_difference
from quire.llm.queries import ORACLES, QUERIES
from tests.llm.test_near_copies import plain_kept
from tests.llm.test_simhash import plain_classes, plain_print


@pytest.fixture(scope="module")
def db(sf):
    return database(sf)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, db, sf, name):
    df = QUERIES[name](spark, sf)
    cursor = db.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert table(df.collect(), df.columns) == table(cursor.fetchall(), columns)
    assert not type_difference(df, db, ORACLES[name])


def test_every_operator_has_a_query():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 14))


def test_near_duplicate_query(spark, sf):
    docs = {r["doc_id"]: plain_print(r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = plain_classes(list(docs.items()), 3)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op5_simhash_bk_trees"](spark, sf).collect()}
    assert got == {i: (f"{p:016x}", want[i]) for i, p in docs.items()}


def stage(spark, sf, name, rows_or_df, tmp_path):
    docs = rows_or_df
    path = str(tmp_path / name)
    dict(corpus_pipeline.STAGES)[name](spark, docs, sf).write.parquet(path)
    return spark.read.parquet(path)


def test_stages(spark, sf, tmp_path):
    """Each stage keeps the columns and what it has no reason to change."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = stage(spark, sf, "quality", docs, tmp_path)
    left = {r["doc_id"]: r for r in good.collect()}
    right = sum((i in left) == bool(q) for i, q in labels.items())
    assert good.columns == docs.columns and right >= 0.97 * len(labels)

    one = stage(spark, sf, "near_copies", good, tmp_path)
    kept = {r["doc_id"] for r in one.collect()}
    assert kept == plain_kept([(i, r["text"]) for i, r in left.items()]) and one.columns == docs.columns

    cut = stage(spark, sf, "repeats", one, tmp_path)
    seen = set()
    for r in sorted(cut.collect(), key=lambda r: r["doc_id"]):
        before, ws = left[r["doc_id"]]["text"], r["text"].split(" ")
        assert r["text"] == before or len(ws) < len(before.split())
        assert r["n_chars"] == len(r["text"])
        if r["text"] == before:
            grams = {tuple(before.encode().split()[k:k + 13]) for k in range(len(before.encode().split()) - 12)}
            assert not grams & seen
        seen |= {tuple(before.encode().split()[k:k + 13]) for k in range(len(before.encode().split()) - 12)}

    mixed = stage(spark, sf, "mix", cut, tmp_path)
    assert {r["doc_id"] for r in mixed.collect()} == {r["doc_id"] for r in cut.collect()} and mixed.columns == docs.columns

    tokens = stage(spark, sf, "tokens", mixed, tmp_path).collect()
    assert len(tokens) == mixed.count() and all(r["n_tokens"] == len(r["token_ids"]) for r in tokens)


def test_near_copy_stage_on_odd_rows(spark, sf, tmp_path):
    a, b = (" ".join(f"{x}{i}" for i in range(50)) for x in "ab")
    rows = [(5, a), (5, a), (9, a), (None, a), (None, b), (None, b), (7, None), (8, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = stage(spark, sf, "near_copies", df, tmp_path).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == sorted([(5, a), (None, b), (7, None)], key=repr)


def test_empty_documents_go_through(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, f in corpus_pipeline.STAGES:
        out = f(spark, docs, sf)
        assert out.count() == 0
        docs = out if "text" in out.columns else docs


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "token_ids"] and out.count() > 0
