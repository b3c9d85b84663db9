"""The index over several builds, and the sources around it."""

import pytest
from pyspark.sql import functions as F

from quire.operators import catalog as C
from quire.operators import maintenance as M
from quire.operators import registry as G
from quire.operators.retrieval import search
from quire.plans import serve
from quire.plans.build import build, ingest, passages
from quire.sources import chunk_lines, pages
from quire.sources.store import Store
from quire.streaming.ingest import ingest_arrivals

PROSE = "Waves on a line travel with a speed that the medium around the conductors decides for them. "


class FakeEngine:
    """Files of pages parted by form feeds; 'bad' cannot be opened.

    A page may begin with 'TITLE size: words' lines; the first page may hold
    'TOC level page: title' lines.
    """

    def __init__(self, source):
        with source.open() as file:
            self.pages = file.read().decode().split("\f")
        if self.pages == ["bad"]:
            raise ValueError("broken")
        self.page_count = len(self.pages)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return None

    def text(self, page):
        if self.pages[page - 1] == "bad page":
            raise ValueError("bad page")
        return self.pages[page - 1]

    def _marked(self, page, word):
        return [x.removeprefix(word + " ") for x in self.pages[page - 1].split("\n") if x.startswith(word + " ")]

    def toc(self):
        entries = [x.split(": ", 1) for x in self._marked(1, "TOC")]
        return [(int(h.split()[0]), t, int(h.split()[1])) for h, t in entries]

    def spans(self, page):
        return [(float(h), 0.0, float(i), t) for i, (h, t) in enumerate(x.split(": ", 1) for x in self._marked(page, "TITLE"))]


def text(sections: int, paragraphs: int, word: str) -> str:
    out = ["[PAGE 1]"]
    for s in range(sections):
        out += [f"1.{s + 1} Section About {word}", ""]
        for _ in range(paragraphs):
            out += [(PROSE + word + " ") * 12, ""]
    return "\n".join(out)


def documents(spark, rows):
    return spark.createDataFrame(
        [(f"d{slot}", f"Title {slot}", "book", "", slot, [], [], None, t) for slot, t in rows],
        "key string, title string, kind string, source string, slot bigint, auto array<string>, "
        "skip_pages array<struct<lo:int,hi:int>>, body_end_page int, text string",
    )


@pytest.fixture()
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "index"), shards=4)


def books(store):
    return {r["book"]: r["count"] for r in store.points().groupBy("book").count().collect()}


def test_builds(spark, store):
    docs = documents(spark, [(0, text(3, 4, "alpha")), (1, text(2, 5, "beta")), (2, text(1, 1, "gamma"))])
    assert {r["key"] for r in build(docs, store).collect()} == {"d0", "d1", "d2"}
    first = books(store)
    assert set(first) == {"d0", "d1", "d2"}

    # ids are dense, in reading order, inside the document's block
    for r in store.points().groupBy("book").agg(F.min("id").alias("a"), F.max("id").alias("z"), F.count("*").alias("n")).collect():
        slot = int(r["book"][1:])
        assert (r["a"], r["z"]) == (slot << 20, (slot << 20) + r["n"] - 1)

    # nothing changed: nothing loaded
    assert build(docs, store).count() == 0

    # one document shrinks: it alone is loaded and leaves no orphans
    shrunk = documents(spark, [(0, text(1, 2, "alpha")), (1, text(2, 5, "beta")), (2, text(1, 1, "gamma"))])
    assert [r["key"] for r in build(shrunk, store).collect()] == ["d0"]
    assert books(store)["d0"] < first["d0"]
    assert books(store)["d1"] == first["d1"]
    chunks = {r["key"]: r["chunks"] for r in store.manifest().collect()}
    assert chunks == books(store)

    # a document without any passage leaves the index
    emptied = documents(spark, [(1, "nothing"), (2, text(1, 1, "gamma"))])
    build(emptied, store)
    assert set(books(store)) == {"d0", "d2"}
    assert {r["key"] for r in store.manifest().filter("chunks > 0").collect()} == {"d0", "d2"}
    assert build(emptied, store).count() == 0

    # force loads everything given
    assert build(docs, store, force=True).count() == 3
    assert build(docs, store, keys=["d1"], force=True).count() == 1


def test_limit_does_not_pass_for_a_full_build(spark, store):
    docs = documents(spark, [(0, text(3, 4, "alpha"))])
    build(docs, store, limit=1)
    assert books(store) == {"d0": 1}
    build(docs, store)
    assert books(store)["d0"] > 1


def test_remove_and_copy(spark, store, tmp_path):
    docs = documents(spark, [(i, text(1, 2, f"word{i}")) for i in range(6)])
    build(docs, store)
    other = Store(spark, str(tmp_path / "copy"), shards=2)
    counts = store.copy_to(other)
    assert counts == (store.count(), 6) and store.copy_to(other) == counts
    assert books(other) == books(store)

    store.remove(docs.filter("slot < 5").select("key"))
    assert set(books(store)) == {"d5"} == {r["key"] for r in store.manifest().collect()}
    store.remove(docs.select("key"))
    assert books(store) == {} and store.manifest().isEmpty()
    assert len(books(other)) == 6
    # the number of shards is the one the index was made with
    assert Store(spark, other.path, shards=99).shards == 2


def test_serving(spark, store):
    docs = documents(spark, [(0, text(2, 3, "alpha")), (1, text(2, 3, "beta"))])
    build(docs, store)
    asked = spark.createDataFrame([(1, "beta waves"), (2, "")], "qid bigint, text string")
    top = serve.search(store, asked, k=1).filter("qid = 1").first()
    assert top["book"] == "d1" and top["rerank_score"] == 1.0
    answers = {r["qid"]: r["rendered"] for r in serve.search_passages(store, asked, k=2, book="d0").collect()}
    assert answers[1].startswith("[1] Title 0 | S1.") and "(chunk_id=" in answers[1]
    none = serve.search_passages(store, asked, book="nope").collect()
    assert {r["rendered"] for r in none} == {C.NO_HITS}
    assert serve.search_passages(store, asked, kind="issue").first()["rendered"] == C.BAD_KIND
    anchors = spark.createDataFrame([(1 << 20,)], "chunk_id bigint")
    assert serve.read_context(store, anchors).first()["rendered"].startswith("[chunk 1048576] <- requested Title 1")
    names = {r["name"] for r in serve.list_books(store, docs).filter("section = 'textbook'").collect()}
    assert names == {"d0", "d1"}
    turns = spark.createDataFrame([(7, 0, "user", "what is alpha"), (7, 1, "assistant", None)], "conv_id bigint, turn bigint, role string, text string")
    question = spark.createDataFrame([(7, "and beta?"), (8, "alpha")], "conv_id bigint, question string")
    rows = {r["conv_id"]: r for r in serve.chat_contexts(store, turns, question, rewrite=lambda t, q: F.concat(q, F.lit(" "), t)).collect()}
    assert rows[7]["query"] == "and beta? user: what is alpha\nassistant: " and rows[8]["query"] == "alpha"
    assert rows[8]["context"].startswith("[1] Title 0")


def test_streamed_arrivals(spark, store, tmp_path):
    docs = documents(spark, [(0, text(1, 2, "alpha")), (1, text(1, 2, "beta"))])
    registry = docs.select("slot", "key", "title", "kind", "source")
    chunks, folder = passages(docs), str(tmp_path / "chunks")
    chunk_lines.write_chunks(chunks.filter("book = 'd0'").coalesce(1), folder)
    run = lambda: ingest_arrivals(spark, folder, str(tmp_path / "state"), registry, store).awaitTermination()
    run()
    assert set(books(store)) == {"d0"}
    chunks.filter("book = 'd1'").coalesce(1).write.mode("append").json(folder)
    run()
    run()
    assert set(books(store)) == {"d0", "d1"}


def test_chunk_lines(spark, tmp_path):
    chunks = passages(documents(spark, [(0, text(2, 4, "alpha")), (1, text(2, 4, "beta"))]))
    chunk_lines.write_chunks(chunks, str(tmp_path / "c"))
    back = chunk_lines.read_chunks(spark, str(tmp_path / "c"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, chunks.collect()))
    first = chunk_lines.read_chunks(spark, str(tmp_path / "c"), limit=1)
    assert sorted(r["id"] for r in first.collect()) == [0, 1 << 20]


def test_marked_text(spark, tmp_path):
    rows = [("a", "[PAGE 1]\nx\n\ny"), ("b", "# c\n[PAGE 2]\nz\n")]
    pages.write_marked_text(spark.createDataFrame(rows, "key string, text string"), str(tmp_path / "t"))
    assert sorted(map(tuple, pages.read_marked_text(spark, str(tmp_path / "t")).collect())) == rows


def test_page_readers(spark, tmp_path):
    (tmp_path / "j" / "2024").mkdir(parents=True)
    for name, body in [("j/2024/a.pdf", "one\ftwo\fthree"), ("j/b.pdf", "bad"), ("j/c.txt", "no")]:
        (tmp_path / name).write_text(body)

    files_opened = FakeEngine
    files = pages.scan_files(spark, str(tmp_path))
    assert sorted(r["path"] for r in files.collect()) == ["j/2024/a.pdf", "j/b.pdf"]
    read = pages.read_pages(files.select("path"), str(tmp_path), files_opened)
    got = {(r["pdf"], r["page"], r["text"], r["error"]) for r in read.collect()}
    assert got == {
        ("j/2024/a.pdf", 1, "one", None), ("j/2024/a.pdf", 2, "two", None), ("j/2024/a.pdf", 3, "three", None),
        ("j/b.pdf", None, None, "ValueError: broken"),
    }
    docs = spark.createDataFrame(
        [("k", "j/2024/a.pdf", "Name", (2, 3), 100)],
        "key string, pdf string, title string, pages struct<lo:int,hi:int>, page_offset int",
    )
    part = G.pages_in_span(docs.select("key", "pdf", "page_offset", "pages.lo", "pages.hi"), read.filter("error is null"))
    got = pages.assemble(docs, part.select("key", "page", "text")).first()["text"]
    assert got.startswith("# SOURCE: a.pdf pages 2-3\n# TITLE: Name\n# PAGES: printed folio\n# EXTRACTION: pymupdf.")
    assert got.endswith("\n\n[PAGE 102]\ntwo\n\n[PAGE 103]\nthree\n")


def test_registration(spark):
    registry = spark.createDataFrame(
        [("lines_old", "old/Lines.pdf", 0), ("known_paper", "j/known.pdf", 2), ("known_paper_2", "j/x.pdf", 3)],
        "key string, pdf string, slot bigint",
    )
    paths = ["j/known.pdf", "books/Lines.pdf", "j/2022 Index Trans Vol. 3.pdf", "j/2024/Known_paper.pdf", "j/2025/known paper.pdf", "j/issue.pdf"]
    files = spark.createDataFrame([(p, 10) for p in paths], "path string, length bigint")
    status = G.triage(files, registry)
    assert {r["path"]: r["status"] for r in status.collect()} == dict(zip(paths, ["known", "moved", "index", "new", "new", "new"]))
    assert {r["key"]: r["pdf"] for r in G.follow_moves(registry, status).collect()}["lines_old"] == "books/Lines.pdf"
    structure = spark.createDataFrame(
        [("j/2024/Known_paper.pdf", 9, False, "A Real Title"), ("j/2025/known paper.pdf", 200, False, "ISSN"), ("j/issue.pdf", 100, True, "")],
        "path string, page_count int, is_issue boolean, title string",
    )
    articles = spark.createDataFrame(
        [("j/issue.pdf", 1, "Cover", "Cover", 1, 3, 7), ("j/issue.pdf", 2, "01", "Coupling in Long Lines", 4, 9, 7), ("j/issue.pdf", 3, "02", "One Page", 10, 10, 7)],
        "path string, nth int, bookmark string, title string, lo int, hi int, page_offset int",
    )
    new = {r["key"]: r for r in G.new_documents(status, structure, articles, registry).collect()}
    assert set(new) == {"known_paper_3", "known_paper_4", "issue_02_coupling_in_long_lines"}
    assert new["known_paper_3"]["title"] == "A Real Title" and new["known_paper_3"]["kind"] == "article"
    assert new["known_paper_4"]["title"] == "known paper" and new["known_paper_4"]["kind"] == "issue"
    assert new["known_paper_3"]["source"] == "j / 2024"
    assert new["issue_02_coupling_in_long_lines"]["pages"] == (4, 9)
    assert sorted(r["slot"] for r in new.values()) == [1, 4, 5]


def test_purge_spares_shared_files(spark):
    reg = spark.createDataFrame([("a", "i.pdf"), ("b", "i.pdf"), ("c", "c.pdf")], "key string, pdf string")
    gone = spark.createDataFrame([("a",), ("c",)], "key string")
    assert [r["pdf"] for r in M.purgeable(reg, gone).collect()] == ["c.pdf"]


def test_search_of_plain_points(spark):
    from quire.functions.encoding import embed

    df = embed(spark.createDataFrame([(1, "red apple"), (2, "green pear")], "id bigint, text string"), "text")
    asked = spark.createDataFrame([(1, "pear")], "qid bigint, text string")
    assert search(df, asked, k=1).first()["id"] == 2
    assert ingest is not None
