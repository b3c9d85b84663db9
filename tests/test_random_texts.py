"""Cleaning and chunking of adversarial random texts, arrays against SQL windows.

The library folds a document inside one row; the SQL works on one row per line.
The texts mix markers, headings, captions, blanks, split words, junk and prose
far more densely than real ones do.
"""

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from checks import text_sql as Q
from quire.operators import pages as P
from quire.operators.chunking import chunk_documents
from quire.operators.cleaning import clean
from quire.plans.build import resolve

WORDS = "the of wave line field matrix long-term propagation impedance Coupling noise crosstalk per unit".split()


def line(rng: random.Random, page: list[int]) -> str:
    kind = rng.random()
    prose = " ".join(rng.choice(WORDS) for _ in range(rng.randint(3, 11)))
    if kind < 0.12:
        page[0] += rng.choice([1, 1, 1, 2, 5])
        return f"[PAGE {page[0]}]"
    if kind < 0.27:
        return rng.choice(["", "", " "])
    if kind < 0.33:
        return rng.choice(["RUNNING HEADER LINE", "SHORT ONE", "12", "xii", "mix", "Chapter 4", "Section 1.2. Lines 14"])
    if kind < 0.39:
        return rng.choice(["Figure 3.1 a cross section", "TABLE 2", "Figure 3a no", "FIGURE 12-4. caption", " Table 5 x"])
    if kind < 0.47:
        return rng.choice(["1.2 The Heading Here", "3.4.5 Another One", "II. SECOND PART", "A. Sub Part", "V. Fifth 12", "# note"])
    if kind < 0.53:
        return rng.choice(["...", "§ ¶", "· .", "--", "a", "(x)"])
    if kind < 0.68:
        return prose + " " + rng.choice(["propaga-", "high-", "per-", "long-", "x-", "no--"])
    if kind < 0.78:
        return rng.choice(["tion of waves", "speed links", "unit length", "term-", "termX y", "tion", "term"])
    if kind < 0.82:
        return "Index, " + ", ".join(str(rng.randint(1, 99)) for _ in range(3))
    if kind < 0.86:
        return prose + " " + str(rng.randint(1, 999))
    if kind < 0.88:
        return " ".join(prose for _ in range(rng.randint(20, 90))).replace("noise", "noise.")
    end = rng.choice([".", "", "", "", ":", ")"])
    return rng.choice(["", "", "", "(", "  "]) + prose + " " + prose[: rng.randint(0, 30)].strip() + end


@pytest.fixture(scope="module", params=[1, 2])
def texts(request):
    rng = random.Random(request.param)
    rows = []
    for slot in range(400):
        page = [rng.randint(0, 3)]
        lines = [line(rng, page) for _ in range(rng.randint(1, 70))]
        kind = rng.choice(["book", "article", "issue"])
        rows.append((slot, f"doc_{slot}", f"Title {slot}", kind, rng.choice(["", "Src"]), "\n".join(lines)))
    return pd.DataFrame(rows, columns=["slot", "key", "title", "kind", "source", "text"])


@pytest.fixture(scope="module")
def db(texts):
    con = duckdb.connect()
    con.register("raw", texts)
    return con


def stages(upto: str) -> str:
    """The SQL stages over the raw texts instead of the laid-out documents."""
    own = {
        "docs": "docs as (select slot, key, title, kind, source from raw)",
        "lines0": """lines0 as (
            select slot, n, line from raw, unnest(string_split(text, chr(10))) with ordinality as u(line, n))""",
    }
    names = list(Q.STAGES)
    return "with recursive " + ",".join(own.get(n, Q.STAGES[n]) for n in names[: names.index(upto) + 1])


@pytest.fixture(scope="module")
def cleaned(spark, texts):
    docs = spark.createDataFrame(texts).repartition(8).select(
        "*",
        F.when(F.col("kind") == "article", F.array().cast("array<string>"))
        .otherwise(F.array(F.lit("skip_pages"), F.lit("body_end_page"))).alias("auto"),
        F.array().cast("array<struct<lo:int,hi:int>>").alias("skip_pages"),
        F.lit(None).cast("int").alias("body_end_page"),
    )
    return clean(resolve(docs), keep_steps=True).cache()


def agree(df, con, sql):
    mine = {r[0]: tuple(r[1:]) for r in df.collect()}
    theirs = {r[0]: tuple(r[1:]) for r in con.execute(sql).fetchall()}
    differing = {k: (mine.get(k), theirs.get(k)) for k in mine.keys() | theirs.keys() if mine.get(k) != theirs.get(k)}
    assert not differing, (len(differing), next(iter(differing.items())))


def text_sql(stage: str, cte: str) -> str:
    lines = f"select slot, string_agg(line, chr(10) order by n) as text from {cte} group by slot"
    return f"{stages(stage)} select d.slot, coalesce(t.text, '') from docs d left join ({lines}) t using (slot)"


def test_trim(cleaned, db):
    agree(cleaned.select("slot", P.join_pages(F.col("_trim.pages"))), db, text_sql("trimmed", "trimmed"))


def test_furniture(cleaned, db):
    agree(cleaned.select("slot", P.join_pages(F.col("_swept"))), db, text_sql("swept", "swept"))


def test_captions(cleaned, db):
    agree(cleaned.select("slot", "_lifted"), db, text_sql("lifted", "lifted"))


def test_hyphens(cleaned, db):
    agree(cleaned.select("slot", "_whole.text"), db, text_sql("joined", "joined"))


def test_clean_text(cleaned, db):
    sql = f"{stages('flowed')} select d.slot, coalesce(clean_text, chr(10)) from docs d left join cleaned using (slot)"
    agree(cleaned.select("slot", "clean_text"), db, sql)


def test_chunks(cleaned, db):
    columns = [
        "id", "book", "book_title", "kind", "source", "chapter", "section", "section_title",
        "page_start", "page_end", "n_tokens", "text", "embed_text",
    ]
    rows = chunk_documents(cleaned).select(*columns)
    assert rows.count() > 400
    agree(rows, db, f"{stages('chunks')} select {', '.join(columns)} from chunks")
