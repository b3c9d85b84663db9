"""Nothing is cut, dropped or mistaken at sizes beyond the ordinary."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quire.__main__ import main
from quire.functions.frames import small
from quire.operators import registry as G
from quire.plans import workbench as B
from quire.sources import pages


def laid_out(spark, tmp_path, text, lang="fr"):
    folder = tmp_path / "tables"
    spark.createDataFrame([(1, text, lang, "s", len(text))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(folder / "documents.parquet"))
    return B.extracted(spark, str(folder)).first()["text"]


def test_a_word_of_two_thousand_letters_is_laid_out_whole(spark, tmp_path):
    text = laid_out(spark, tmp_path, " ".join(["Word"] * 8 + ["abcd" + "x" * 1996] + ["tail"] * 9))
    assert text.count("x") == 1996 + text.count("index")


def test_every_heading_of_a_long_article_is_there(spark, tmp_path):
    text = laid_out(spark, tmp_path, "\n".join(f"par{i} words here" for i in range(200)))
    assert sum("Study par" in line for line in text.split("\n")) == 40


def brute_keys(bases, taken):
    used, out = set(taken), []
    for b in bases:
        key, n = b or "doc", 2
        while key in used:
            key, n = f"{b or 'doc'}_{n}", n + 1
        used.add(key)
        out.append(key)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_keys_are_given_row_by_row(spark, seed):
    r = random.Random(seed)
    names = ["x", "x_2", "x_3", "x_2_2", "y", "y_4", "", "doc", "doc_2", "x_10", "z_1", "x_02"]
    bases = [["x", "x", "x_2"], ["x_2", "x", "x"], ["x"] * 5 + ["x_3", "x_3", "x_2", "x_2_2"]][seed] if seed < 3 else [
        r.choice(names) for _ in range(r.randint(5, 60))]
    taken = [] if seed < 3 else r.sample(names, 3) + ["x_12345678901234"]
    wanted = spark.createDataFrame([(f"{i:04d}", b) for i, b in enumerate(bases)], "path string, base string")
    held = spark.createDataFrame([(k,) for k in taken if k], "key string")
    got = [x["key"] for x in G.unique_keys(wanted, held).orderBy("path").collect()]
    assert got == brute_keys(bases, [k for k in taken if k])


def test_sizes_are_rounded_by_their_binary_value(spark):
    sizes = [9.95, 10.35, 8.05, 9.25, 9.75, 12.0, 7.449999999999999, 0.05, 11.96, 10.15, 10.45, 10.55, 10.65, 10.85]
    sizes += [random.Random(1).uniform(1, 40) for _ in range(200)] + [k + d / 100 for k in range(1, 30) for d in range(5, 100, 10)]
    got = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "i int, size double").select("i", G.tenths("size").alias("t")).collect()
    assert {r["i"]: r["t"] for r in got} == {i: round(s, 1) for i, s in enumerate(sizes)}


def test_article_numbers_of_six_digits_keep_their_order(spark):
    structure = spark.createDataFrame([("a/v.pdf", 400_000, True, "")], "path string, page_count int, is_issue boolean, title string")
    nth = [2, 10, 99_999, 100_000, 100_001, 1_000_000]
    articles = spark.createDataFrame(
        [("a/v.pdf", n, "b", f"A Title of Article {n}", 3 * n, 3 * n + 2, None) for n in nth],
        "path string, nth int, bookmark string, title string, lo int, hi int, page_offset int")
    files = spark.createDataFrame([("a/v.pdf", "new")], "path string, status string")
    none = spark.createDataFrame([], "key string, slot bigint")
    got = G.new_documents(files, structure, articles, none).orderBy("slot").collect()
    assert [r["title"].split()[-1] for r in got] == [str(n) for n in nth]


@pytest.mark.parametrize("name", ["v1+x", "a (b) [c]".replace("[c]", "c"), "dots.and blanks", "%20"])
def test_roots_of_any_name(spark, tmp_path, name):
    root = tmp_path / name
    (root / "in ner").mkdir(parents=True)
    for f in ("in ner/a+b.pdf", "c%20d.pdf"):
        (root / f).write_text("x")
    assert {r["path"] for r in pages.scan_files(spark, str(root)).collect()} == {"in ner/a+b.pdf", "c%20d.pdf"}


def test_first_path_folder_by_folder(spark):
    files = spark.createDataFrame([("a-b/x.pdf", 5), ("a/x.pdf", 5), ("a/X.pdf", 6), ("a/~x.pdf", 5)], "path string, length bigint")
    assert {(r["length"], r["path"]) for r in G.distinct_files(files).collect()} == {(5, "a/x.pdf"), (6, "a/X.pdf")}


def test_titles_behind_a_wide_space(spark):
    rows = spark.createDataFrame([(" Contents",), ("　Editorial of May",), ("١٩٩٩ Index",), ("Waves in Lines",)], "title string")
    keep = G.keep_article(F.lit("1"), F.col("title"), F.lit(1), F.lit(9))
    assert [r[0] for r in rows.select(keep).collect()] == [False, False, False, True]


def test_a_wide_side_is_not_broadcast(spark):
    wide = spark.range(10).select("id", F.repeat(F.lit("x"), 1000).alias("text"))
    plan = lambda size: small(wide, 100, size)._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(1 << 20) and "broadcast" not in plan(5000)


def test_status_shows_every_source_and_missing_texts_are_named(spark, tmp_path, capsys):
    documents = {f"k{i}": {"pdf": f"{i}/a.pdf", "title": f"T{i}", "slot": i, "source": f"journal {i}"} for i in range(300)}
    registry = tmp_path / "corpus.json"
    registry.write_text(json.dumps({"documents": documents}))
    body = "Crosstalk grows with the length over which lines run side by side. " * 12
    pages.write_marked_text(spark.createDataFrame([("k1", f"[PAGE 1]\n1.1 Lines\n\n{body}")], "key string, text string"), str(tmp_path / "texts"))
    index = ["--index", str(tmp_path / "index"), "--registry", str(registry)]
    main(["build", *index, "--texts", str(tmp_path / "texts")])
    out = capsys.readouterr().out
    assert out.count("MISSING") == 299 and "k1  " in out
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "z.pdf").write_text("x")
    main(["status", *index, "--files", str(tmp_path / "files")])
    out = capsys.readouterr().out
    assert all(f"journal {i}  1" in out for i in range(300)) and "TOTAL  300" in out
    main(["books", *index, "--source", "nowhere"])
    assert "Nothing indexed under 'nowhere'" in capsys.readouterr().out


def test_pages_that_share_a_number(spark):
    from quire.operators import pages as P

    contents = "CONTENTS\n" + "\n".join(f"Part {i} {i + 3}" for i in range(8))
    index = "INDEX\n" + "\n".join(f"word{i}, {i}, {i + 9}" for i in range(10))
    prose = "\n".join("Waves travel along the line and are reflected where it ends in something else than itself " * 2 for _ in range(4))
    book = lambda numbered: "\n".join(f"[PAGE {n}]\n{body}" for n, body in numbered)
    fronts = {
        "twin": book([(1, contents), (5, contents), (5, "plain words"), (6, prose)]),
        "twin first": book([(1, contents), (5, "plain words"), (5, contents), (6, prose)]),
        "alone": book([(1, contents), (5, contents), (6, prose), (7, prose)]),
        "prose": book([(1, contents), (2, "short"), (2, prose), (3, "x")]),
    }
    backs = {
        "run": book([(n, prose) for n in range(1, 41)] + [(41, index), (42, "x"), (43, "x"), (44, index), (45, index), (46, "about")]),
        "gap": book([(n, prose) for n in range(1, 41)] + [(41, index), (42, "x"), (43, "x"), (44, "x"), (45, index), (46, index), (47, index)]),
        "short": book([(n, prose) for n in range(1, 41)] + [(41, index), (42, index)]),
    }
    rows = spark.createDataFrame([*fronts.items(), *backs.items()], "name string, text string")
    split = rows.select("name", P.split_pages(F.col("text")).alias("p"))
    got = {r["name"]: (r["f"], r["b"]) for r in split.select("name", P.front_matter(F.col("p")).alias("f"), P.back_matter(F.col("p")).alias("b")).collect()}
    assert {n: [tuple(x) for x in got[n][0]] for n in fronts} == {"twin": [(1, 5)], "twin first": [(1, 5)], "alone": [(1, 5)], "prose": [(1, 1)]}
    assert {n: got[n][1] for n in backs} == {"run": 41, "gap": 45, "short": None}
