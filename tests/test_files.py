"""From files on disk to answers: scan, extract, build, search, remove."""

import json
import random
import uuid
from hashlib import md5
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quire.__main__ import main
from quire.plans import serve
from quire.plans.build import build
from quire.plans.extract import extract
from quire.plans.register import conform, register
from quire.sources import files, pages
from quire.sources.registry_file import open_registry, read_registry, save_registry, write_registry_file
from quire.sources.store import Store
from tests.test_index import FakeEngine

BODY = "Waves on a line travel with a speed that the medium around the conductors decides for them. " * 6


def issue() -> str:
    """Ten articles of nine pages, folios 100 ahead of the file, and a cover that is none."""
    toc = ["TOC 1 1: Front cover"] + [f"TOC 1 {2 + 9 * k}: {k:02d}" for k in range(10)] + ["TOC 2 5: inner"]
    out = ["\n".join(toc)]
    for p in range(2, 92):
        k, first = divmod(p - 2, 9)
        head = f"TITLE 18.04: Coupling in Lines\nTITLE 18.0: of Kind {k}\nTITLE 9.0: small type\n" if first == 0 else ""
        out.append(f"{p + 100}\n{head}subject{k} {BODY}")
    return "\f".join(out)


def corpus(folder):
    (folder / "J" / "2024").mkdir(parents=True)
    (folder / "new place").mkdir()
    (folder / "J" / "2024" / "issue.pdf").write_text(issue())
    (folder / "J" / "paper_on_noise.pdf").write_text(f"TITLE 20: A Paper about Noise\nnoise {BODY}\fmore noise {BODY}")
    (folder / "new place" / "moved.pdf").write_text(f"moved {BODY}")
    (folder / "J" / "broken.pdf").write_text("bad")
    (folder / "J" / "scanned.pdf").write_text("TITLE 20: Pictures without any Text\n1\f2\f3\f4")
    (folder / "J" / "2022 Index Trans Vol. 3.pdf").write_text("x")


def test_from_files_to_answers(spark, tmp_path):
    corpus(tmp_path / "files")
    root = str(tmp_path / "files")
    known = spark.createDataFrame([("moved", "old/moved.pdf", "Moved Book", "book", "", 0)], "key string, pdf string, title string, kind string, source string, slot bigint")
    registry, report = register(pages.scan_files(spark, root), root, known, FakeEngine)
    seen = {r["path"]: (r["status"], r["documents"], r["error"]) for r in report.collect()}
    assert seen == {
        "J/2024/issue.pdf": ("new", 10, None), "J/paper_on_noise.pdf": ("new", 1, None), "J/scanned.pdf": ("new", 1, None),
        "new place/moved.pdf": ("moved", 0, None), "J/broken.pdf": ("failed", 0, "ValueError: broken"),
        "J/2022 Index Trans Vol. 3.pdf": ("index", 0, None),
    }
    rows = {r["key"]: r for r in registry.collect()}
    assert rows["moved"]["pdf"] == "new place/moved.pdf" and rows["moved"]["slot"] == 0
    articles = sorted((r for r in rows.values() if r["pdf"].endswith("issue.pdf")), key=lambda r: r["slot"])
    assert [r["key"] for r in articles] == [f"issue_{k + 2:02d}_coupling_in_lines_of_kin" for k in range(10)]
    assert articles[3]["title"] == "Coupling in Lines of Kind 3" and articles[3]["pages"] == (29, 37)
    assert {r["page_offset"] for r in articles} == {100} and {r["source"] for r in articles} == {"J / 2024"}
    assert rows["paper_noise"]["title"] == "A Paper about Noise"
    assert sorted(r["slot"] for r in rows.values()) == list(range(13))

    none = spark.createDataFrame([], "key string, text string")
    fresh, report, after = extract(registry, none, root, FakeEngine)
    status = {r["key"]: r["status"] for r in report.collect()}
    assert status == {k: "NO TEXT LAYER" if k == "scanned" else "extracted" for k in rows}
    texts = {r["key"]: r["text"] for r in fresh.collect()}
    assert "[PAGE 129]" in texts[articles[3]["key"]] and "subject3" in texts[articles[3]["key"]] and "subject2" not in texts[articles[3]["key"]]
    pages.write_marked_text(fresh, str(tmp_path / "texts"))
    again, report, _ = extract(after, pages.read_marked_text(spark, str(tmp_path / "texts")), root, FakeEngine)
    assert {r["status"] for r in report.collect()} == {"cached", "NO TEXT LAYER"} and again.isEmpty()

    store = Store(spark, str(tmp_path / "index"), shards=4)
    build(after.drop("text").join(pages.read_marked_text(spark, str(tmp_path / "texts")), "key"), store)
    asked = spark.createDataFrame([(1, "subject7 waves")], "qid bigint, text string")
    hit = serve.search(store, asked, k=1).first()
    assert hit["book"] == articles[7]["key"] and hit["page_start"] >= 165

    # a changed file is read again
    (tmp_path / "files" / "J" / "paper_on_noise.pdf").write_text(f"TITLE 20: A Paper about Noise\nquieter {BODY}")
    fresh, report, _ = extract(after, pages.read_marked_text(spark, str(tmp_path / "texts")), root, FakeEngine)
    assert [r["key"] for r in fresh.collect()] == ["paper_noise"] and "quieter" in fresh.first()["text"]


@pytest.mark.parametrize("at", [4, 100])
def test_a_file_with_a_failing_page_gives_no_text(spark, tmp_path, monkeypatch, at):
    """Pages before the bad one are not stored, whichever task read them; the next run tries again and sees the repair."""
    monkeypatch.setattr(pages, "SHARE", 512)
    (tmp_path / "f").mkdir()
    whole = [f"page {p} {BODY}" for p in range(1, 121)]
    (tmp_path / "f" / "a.pdf").write_text("\f".join(x if p != at else "bad page" for p, x in enumerate(whole, 1)))
    (tmp_path / "f" / "b.pdf").write_text(f"other {BODY}")
    registry = conform(spark.createDataFrame([("a", "a.pdf", 0), ("b", "b.pdf", 1)], "key string, pdf string, slot bigint"))
    none = spark.createDataFrame([], "key string, text string")
    fresh, report, after = extract(registry, none, str(tmp_path / "f"), FakeEngine)
    assert {r["key"]: r["status"] for r in report.collect()} == {"a": "failed", "b": "extracted"}
    assert [r["key"] for r in fresh.collect()] == ["b"] and {r["key"]: r["pdf_hash"] is None for r in after.collect()} == {"a": True, "b": False}
    texts = spark.createDataFrame(fresh.collect(), fresh.schema)
    again, report, _ = extract(after, texts, str(tmp_path / "f"), FakeEngine)
    assert {r["key"]: r["status"] for r in report.collect()} == {"a": "failed", "b": "cached"} and again.isEmpty()
    (tmp_path / "f" / "a.pdf").write_text("\f".join(whole))
    again, report, _ = extract(after, texts, str(tmp_path / "f"), FakeEngine)
    assert {r["key"]: r["status"] for r in report.collect()} == {"a": "extracted", "b": "cached"}
    assert again.first()["text"].count("[PAGE ") == 120


class Counted(FakeEngine):
    """Leaves a mark for each file opened."""

    def __init__(self, source):
        (Path(source.path).parent.parent / "opened" / f"{Path(source.path).name}-{uuid.uuid4().hex}").touch()
        super().__init__(source)


def test_only_wanted_files_are_opened_and_large_ones_by_many_tasks(spark, tmp_path):
    for name in ("f", "opened"):
        (tmp_path / name).mkdir()
    for i in range(10):
        (tmp_path / "f" / f"{i}.pdf").write_text("\f".join(f"{i} page {p}" for p in range(1, 101)))
    wanted = spark.createDataFrame([("3.pdf", [(2, 5), (90, 200)])], "path string, wanted array<struct<lo:int,hi:int>>")
    got = sorted((r["pdf"], r["page"], r["text"]) for r in pages.read_pages(wanted, str(tmp_path / "f"), Counted, share=200).collect())
    assert got == [("3.pdf", p, f"3 page {p}") for p in [2, 3, 4, 5, *range(90, 101)]]
    opened = [p.name.split("-")[0] for p in (tmp_path / "opened").iterdir()]
    size = (tmp_path / "f" / "3.pdf").stat().st_size
    assert set(opened) == {"3.pdf"} and len(opened) == -(-size // 200)


def test_formfeed_files_are_read_by_ranges(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("one\ftw\u00f6\f\fla\nst".encode())
    (tmp_path / "b.txt").write_bytes(b"one\f")
    (tmp_path / "c.txt").write_bytes(b"")
    names = spark.createDataFrame([(x,) for x in ("a.txt", "b.txt", "c.txt")], "path string")
    for share in (2, 1 << 20):
        got = sorted((r["pdf"], r["page"], r["text"], r["error"]) for r in pages.read_pages(names, str(tmp_path), "formfeed", share=share).collect())
        assert got == [("a.txt", 1, "one", None), ("a.txt", 2, "tw\u00f6", None), ("a.txt", 3, "", None), ("a.txt", 4, "la\nst", None), ("b.txt", 1, "one", None)]


def test_hashes_of_files_in_blocks(spark, tmp_path):
    def fold(data, block):
        parts = [md5(data[i:i + block]).hexdigest() for i in range(0, len(data), block)]
        return parts[0] if len(parts) == 1 else md5("".join(parts).encode()).hexdigest()

    r = random.Random(1)
    data = {f"{i}.pdf": r.randbytes(n) for i, n in enumerate((1, 999, 1000, 1001, 54321))}
    data["with space \u00e9%20.pdf"] = b"named"
    for name, x in data.items():
        (tmp_path / name).write_bytes(x)
    found = files.listing(spark, str(tmp_path)).select("path", "uri", "length")
    got = {r["path"]: r["file_hash"] for r in files.content_hashes(found, block=1000).collect()}
    assert got == {name: fold(x, 1000) for name, x in data.items()}
    one = {r["path"]: r["file_hash"] for r in files.content_hashes(found).collect()}
    assert one == {name: md5(x).hexdigest() for name, x in data.items()}
    gone = found.withColumn("uri", F.concat("uri", F.lit("x")))
    assert {r["file_hash"] for r in files.content_hashes(gone).collect()} == {None}


def test_a_sparse_file_over_two_gigabytes(spark, tmp_path):
    """Its blocks are hashed where they are read; no row holds the file."""
    with open(tmp_path / "large.pdf", "wb") as f:
        f.truncate((2 << 30) + 5)
    found = files.listing(spark, str(tmp_path)).select("path", "uri", "length")
    block, rest = md5(bytes(64 << 20)).hexdigest(), md5(bytes(5)).hexdigest()
    assert files.content_hashes(found, block=64 << 20).first()["file_hash"] == md5((block * 32 + rest).encode()).hexdigest()


def test_commands_on_files(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setitem(pages.ENGINES, "pymupdf", FakeEngine)
    corpus(tmp_path / "files")
    registry, texts = tmp_path / "corpus.json", tmp_path / "texts"
    on = ["--registry", str(registry), "--files", str(tmp_path / "files")]
    registry.write_text(json.dumps({"banner_patterns": ["^B"], "documents": {}}))
    main(["scan", *on])
    assert "J/broken.pdf  failed  0  ValueError: broken" in capsys.readouterr().out
    main(["extract", *on, "--texts", str(texts)])
    assert "scanned  NO TEXT LAYER" in capsys.readouterr().out
    main(["extract", *on, "--texts", str(texts), "--only", "paper_noise", "--force"])
    assert "paper_noise  extracted" in capsys.readouterr().out
    assert pages.read_marked_text(spark, str(texts)).filter("key = 'paper_noise'").count() == 1
    index = ["--index", str(tmp_path / "index"), "--registry", str(registry)]
    main(["build", *index, "--texts", str(texts), "--shards", "2"])
    assert "scanned: MISSING" in capsys.readouterr().out
    main(["remove", *index, "paper_noise", "--purge", "--files", str(tmp_path / "files"), "--texts", str(texts)])
    assert not (tmp_path / "files" / "J" / "paper_on_noise.pdf").exists()
    kept = json.loads(registry.read_text())
    assert "paper_noise" not in kept["documents"] and kept["banner_patterns"] == ["^B"] and len(kept["documents"]) == 12
    assert pages.read_marked_text(spark, str(texts)).filter("key = 'paper_noise'").isEmpty()
    main(["scan", *on])
    assert "paper_on_noise" not in capsys.readouterr().out
    assert "paper_noise" not in json.loads(registry.read_text())["documents"]


def test_registry_goes_back_and_forth(spark, tmp_path):
    file = tmp_path / "corpus.json"
    file.write_text(json.dumps({"collection": "x", "documents": {"é \"q\"": {"pdf": "i.pdf", "title": "T", "slot": 4, "text": "own.txt", "pages": [3, 9], "skip_pages": [[1, 2]]}}}))
    rows = read_registry(spark, str(file))
    before = rows.collect()
    write_registry_file(spark.createDataFrame(before, rows.schema), str(file))
    assert read_registry(spark, str(file)).collect() == before and json.loads(file.read_text())["collection"] == "x"
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "own.txt").write_text("[PAGE 1]\nx\n")
    assert [tuple(r) for r in pages.read_marked_text(spark, str(tmp_path / "t"), rows).collect()] == [('é "q"', "[PAGE 1]\nx\n")]
    assert rows.select(F.col("text")).first()[0] == "own.txt"


def test_registry_table_rewrites_only_changed_shards(spark, tmp_path):
    path = str(tmp_path / "registry")
    assert open_registry(spark, path).isEmpty()
    rows = conform(spark.range(40).selectExpr("concat('k', id) as key", "concat(id, '.pdf') as pdf", "id as slot", "'T' as title"))
    save_registry(rows, path, shards=4)
    assert sorted(map(str, open_registry(spark, path).collect())) == sorted(map(str, rows.collect()))
    files_of = lambda: {p.parent.name: p.name for p in Path(path).rglob("shard=*/part-*.parquet")}
    before = files_of()
    save_registry(open_registry(spark, path), path, shards=4)
    assert files_of() == before
    one = open_registry(spark, path).withColumn("title", F.when(F.col("key") == "k7", "New").otherwise(F.col("title")))
    save_registry(one, path, shards=4)
    after = files_of()
    assert sum(before[x] != after[x] for x in before) == 1
    save_registry(open_registry(spark, path).where("slot >= 30"), path, shards=4)
    assert {r["slot"] for r in open_registry(spark, path).collect()} == set(range(30, 40))
    save_registry(open_registry(spark, path).limit(0), path, shards=4)
    assert open_registry(spark, path).isEmpty()


def test_one_command_from_files_to_index(spark, tmp_path, capsys, monkeypatch):
    """Files, a registry table and an index by one command; then one file changes and one is added."""
    monkeypatch.setitem(pages.ENGINES, "pymupdf", FakeEngine)
    corpus(tmp_path / "files")
    on = ["up", *(x for name in ("registry", "files", "texts", "index") for x in (f"--{name}", str(tmp_path / name))), "--shards", "2"]
    with pytest.raises(SystemExit, match="1 documents have no text layer"):
        main(on)
    main([*on, "--keep-going", "--no-ingest"])
    assert "stopped before the index" in capsys.readouterr().out and Store(spark, str(tmp_path / "index")).count() == 0
    main([*on, "--keep-going"])
    assert "J/broken.pdf  failed" in capsys.readouterr().out
    store = Store(spark, str(tmp_path / "index"))
    books = {r["key"] for r in store.manifest().collect()}
    assert "paper_noise" in books and len(books) == 12
    (tmp_path / "files" / "J" / "paper_on_noise.pdf").write_text(f"TITLE 20: A Paper about Noise\nquieter {BODY}")
    (tmp_path / "files" / "J" / "late_paper.pdf").write_text(f"TITLE 20: A Paper that came late\nlate {BODY}")
    main([*on, "--keep-going"])
    out = capsys.readouterr().out
    assert "J/late_paper.pdf  new  1" in out and "paper_noise  extracted" in out and "moved  cached" in out
    loaded = {x.split("  ")[0] for x in out.split("key  chunks\n")[1].splitlines()[:-1]}
    assert loaded == {"paper_noise", "late_paper"}
    assert {r["book"] for r in store.points().filter("text like '%quieter%'").collect()} == {"paper_noise"}
    main(["registry", "--from", str(tmp_path / "registry"), "--to", str(tmp_path / "out.json")])
    assert len(json.loads((tmp_path / "out.json").read_text())["documents"]) == 14
