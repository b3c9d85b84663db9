"""One query per operator, each over the whole of its tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.encoding import embed
from quire.functions.frames import prefix_sum
from quire.operators import catalog as CT
from quire.operators import chunking as K
from quire.operators import cleaning as CL
from quire.operators import maintenance as M
from quire.operators import pages as P
from quire.operators import registry as G
from quire.operators import retrieval as R
from quire.operators import sections as S
from quire.plans import workbench as B

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
c = F.col


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# ---- sources ----------------------------------------------------------------


@query
def distinct_files(spark, d):
    """One path per size and file name; two files of a name differ in their folders only."""
    docs = B.table(spark, d, "documents")
    name = F.concat(F.when(c("doc_id") % 11 == 0, "~").otherwise(""), F.upper("lang"), (c("n_chars") % 50).cast("string"), F.lit(".pdf"))
    folder = F.concat("source", F.when(c("doc_id") % 2 == 0, "-b/").otherwise("/"), (c("doc_id") % 7).cast("string"), F.lit("/"))
    files = docs.select(F.concat(folder, name).alias("path"), (c("n_chars") % 90).alias("length"))
    return G.distinct_files(files).select("length", "name", "path")


@query
def formfeed_pages(spark, d):
    """A text with form feeds between pages, split again; pages start at the span."""
    from quire.sources.pages import formfeed_pages as split

    docs = B.table(spark, d, "documents").select(
        c("doc_id").alias("pdf"), F.replace("text", F.lit("\n"), F.lit("\f")).alias("text"),
        F.lit(3).alias("first"),
    )
    return split(docs).select("pdf", "page", F.md5("text").alias("text_md5"))


@query
def page_source(spark, d):
    """All texts in files of 500, a page each and more where a text has form feeds, read back page by page.

    Files are read in parts of 64 kB, so the pages of one come from several tasks.
    """
    from quire.functions.frames import shared_folder
    from quire.sources.pages import read_pages, scan_files

    folder = f"{shared_folder(spark)}/volumes-{uuid.uuid4().hex}"
    docs = B.table(spark, d, "documents").select(F.expr("doc_id div 500").alias("volume"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs.repartition("volume").sortWithinPartitions("volume", "doc_id").select("volume", "text").write.partitionBy("volume").option("lineSep", "\f").text(folder)
    read = read_pages(scan_files(spark, folder, "*.txt"), folder, "formfeed", share=1 << 16)
    volume = F.regexp_extract("pdf", "volume=([0-9]+)", 1).cast("bigint").alias("volume")
    return read.select(volume, "page", F.md5("text").alias("text_md5"), "error")


@query
def page_marker_render(spark, d):
    docs = B.table(spark, d, "documents")
    return docs.select(
        "doc_id",
        P.render_page(c("doc_id"), c("text"), F.length("source")).alias("rendered"),
    )


@query
def split_pages(spark, d):
    """Every page of every laid-out document, the unnumbered opening included."""
    docs = B.extracted(spark, d)
    return docs.select("slot", F.explode(P.split_pages(c("text"))).alias("p")).select(
        "slot", c("p.page").alias("page"), F.size("p.lines").alias("n_lines"),
        F.md5(F.array_join("p.lines", "\n")).alias("lines_md5"),
    )


@query
def limit_per_group(spark, d):
    return M.first_per_group(B.table(spark, d, "documents"), 5, "source", "doc_id").select("source", "doc_id")


@query
def migrate_upsert(spark, d):
    """Points copied over an older store; ids of both sides appear once."""
    docs = B.table(spark, d, "documents")
    source = docs.filter(c("lang") != "fr").select(c("doc_id").alias("id"), F.md5("text").alias("payload"))
    target = docs.filter(c("lang") != "en").select(c("doc_id").alias("id"), F.lit("old").alias("payload"))
    return M.copy_into(source, target)


# ---- registration -----------------------------------------------------------


@query
def slug(spark, d):
    return B.table(spark, d, "part").select("p_partkey", T.slug(c("p_name")).alias("slug"))


@query
def short_key(spark, d):
    return B.documents(spark, d).select("doc_id", T.short_key(c("text")).alias("short_key"))


@query
def unique_key(spark, d):
    """Keys of all documents: many share a first word, some carry a number, half of the words are taken."""
    word = T.slug(F.get(F.split("text", "[ \n]+", 2), F.lit(0)))
    base = F.when(c("doc_id") % 3 == 0, F.concat(word, F.lit("_"), (c("doc_id") % 4 + 2).cast("string"))).otherwise(word)
    docs = B.table(spark, d, "documents").select(
        F.lpad(c("doc_id").cast("string"), 12, "0").alias("path"), base.alias("base"))
    taken = docs.where(F.length("base") % 2 == 0).select(c("base").alias("key")).distinct()
    return G.unique_keys(docs, taken).select("path", "key")


@query
def article_key(spark, d):
    docs = B.table(spark, d, "documents")
    path = F.concat("source", F.lit("/Vol "), "lang", F.lit(".pdf"))
    title = F.element_at(F.split("text", "\n"), 1)
    return docs.select("doc_id", G.article_key(path, c("doc_id"), title).alias("article_key"))


@query
def free_slots(spark, d):
    """Slots for all customers next to the slots the orders already use."""
    new = B.table(spark, d, "customer").select(F.lpad(c("c_custkey").cast("string"), 12, "0").alias("path"))
    used = B.table(spark, d, "orders").select(c("o_orderkey").alias("slot"))
    return G.free_slots(new, used)


@query
def source_label(spark, d):
    pages = B.table(spark, d, "pages")
    return pages.select("page_id", T.source_label(c("url")).alias("label"))


def pdf_pages(spark, d) -> DataFrame:
    """Documents bound into one file per language, a page each, in id order."""
    docs = B.documents(spark, d)
    at = prefix_sum(docs.select("doc_id", c("lang").alias("pdf")), ["doc_id"], group=["pdf"], name="page")
    return docs.join(at, "doc_id").select("pdf", c("page").cast("int").alias("page"), "text", "n_chars", "doc_id", "source")


def outline(spark, d) -> DataFrame:
    pages = pdf_pages(spark, d)
    return pages.filter(c("n_chars") > 1000).select(
        "pdf", c("page").alias("ord"), F.when(c("n_chars") > 3000, 1).otherwise(2).alias("level"),
        F.concat(F.lit(" "), F.element_at(F.split("text", "\n"), 1), F.lit(" ")).alias("title"), "page",
    )


def page_counts(spark, d) -> DataFrame:
    return B.table(spark, d, "documents").groupBy(c("lang").alias("pdf")).agg(F.count(F.lit(1)).cast("int").alias("page_count"))


def spans(spark, d) -> DataFrame:
    return G.article_spans(G.top_outline(outline(spark, d)), page_counts(spark, d))


@query
def top_outline(spark, d):
    return G.top_outline(outline(spark, d))


@query
def article_spans(spark, d):
    return spans(spark, d)


@query
def issue_classifier(spark, d):
    """One file per source and language with an entry for every document, its title the first line.

    Depth and page go by the text: entries of inner levels and of page zero do
    not count, so some files are too short and some have too few entries.
    """
    docs = B.table(spark, d, "documents").select(F.concat_ws("-", "source", "lang").alias("pdf"), "doc_id", "n_chars", "text")
    counts = docs.groupBy("pdf").agg((F.count(F.lit(1)) + 70 + F.min("doc_id") % 15).cast("int").alias("page_count"))
    line = F.element_at(F.split("text", "\n"), 1)
    marks = docs.select(
        "pdf", c("doc_id").alias("ord"), (1 + F.length(line) % 8).cast("int").alias("level"), line.alias("title"),
        (c("n_chars") % 5).cast("int").alias("page"))
    return G.issues(G.top_outline(marks), counts)


@query
def page_titles(spark, d):
    """Lines as type: the shorter a line, the larger it is set; all sizes lie on a border of rounding."""
    docs = B.documents(spark, d)
    lines = docs.select("lang", "doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    set_type = lines.select(
        c("lang").alias("pdf"), c("doc_id").alias("page"), (F.lit(40.05) - F.least(F.length("text"), F.lit(300)) / 10).alias("size"),
        (c("n") % 7).cast("double").alias("x"), (c("n") * 12.25).alias("y"), "text",
    )
    return G.page_titles(set_type)


@query
def folio_candidates(spark, d):
    docs = B.documents(spark, d)
    return docs.select(
        "doc_id", F.array_join(F.array_sort(G.folio_candidates(folioed(c("text"), c("doc_id")))), ",").alias("folios")
    )


def folioed(text, page):
    """A page's text with a printed head and foot line."""
    return F.concat(
        F.lit("Vol. 12, "), (page + 417).cast("string"), F.lit("\n"), text, F.lit("\n"),
        F.lit("April 2023 "), (page + 417).cast("string"), F.lit(" 123456"),
    )


@query
def offset_vote(spark, d):
    """One file per source and language, a page for each document with its whole text below a folio line.

    Folios are printed on some pages only, so files fall short of three votes,
    and two rows of folios compete, so counts tie. Every page is an article.
    """
    docs = B.table(spark, d, "documents").select(F.concat_ws("-", "source", "lang").alias("pdf"), "doc_id", "n_chars")
    at = prefix_sum(docs, ["doc_id"], group=["pdf"], name="_page").withColumn("page", c("_page").cast("int"))
    folio = F.when(c("n_chars") % 3 == 0, (c("page") + 400).cast("string")).when(
        c("n_chars") % 3 == 1, (c("page") + 100).cast("string")).otherwise("")
    texts = B.table(spark, d, "documents").select("doc_id", "text")
    pages = at.join(texts, "doc_id").select(
        "pdf", "page", F.concat(F.lit("Proc. "), folio, F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text"))
    return G.page_offsets(at.select("pdf", c("page").alias("lo"), c("page").alias("nth")), pages)


@query
def skip_titles(spark, d):
    docs = B.table(spark, d, "documents")
    lead = F.when(c("lang") == "de", "Table of Contents ").when(c("source") == "src3", "Guest Editorial: ").when(
        c("source") == "src4", "2022 Index ").otherwise("")
    title = F.concat(lead, F.element_at(F.split("text", "\n"), 1))
    bookmark = F.when(c("source") == "src5", "Front cover").otherwise(F.element_at(F.split("text", " "), 1))
    name = F.concat(F.when(c("source") == "src6", "2022 Index IEEE Vol. ").otherwise("paper "), "doc_id", F.lit(".pdf"))
    return docs.select(
        "doc_id",
        G.keep_article(bookmark, title, F.lit(1), F.length("source")).alias("keep"),
        G.is_volume_index(name).alias("volume_index"),
    )


@query
def register_merge(spark, d):
    """Files found again, found elsewhere, volume indexes and new ones."""
    docs = B.table(spark, d, "documents")
    name = F.concat(F.when(c("source") == "src7", "Index of Vol ").otherwise("d"), c("doc_id").cast("string"), F.lit(".pdf"))
    files = docs.select(F.concat("lang", F.lit("/"), name).alias("path"))
    registered = docs.filter(c("lang").isin("fr", "es")).select(
        F.concat(F.when(c("lang") == "fr", c("lang")).otherwise("old"), F.lit("/"), name).alias("pdf")
    )
    return G.triage(files, registered)


@query
def shouty_prune(spark, d):
    docs = B.table(spark, d, "documents")
    title = F.element_at(F.split("text", "\n"), 1)
    rows = docs.select(
        "doc_id", F.when(c("lang") == "de", F.upper(title)).otherwise(title).alias("title"),
        F.when(c("lang") == "es", "book").otherwise("article").alias("kind"),
    )
    return G.prune(rows).select("doc_id", "kind")


@query
def bad_records(spark, d):
    """Event payloads, some cut short: each with what is wrong with it."""
    from quire.sources.chunk_lines import parse_permissive

    events = B.table(spark, d, "events").select(
        "event_id", F.when(c("event_type") == "click", F.left("props", F.length("props") - 1)).otherwise(c("props")).alias("line"))
    return parse_permissive(events, "line").select("event_id", F.coalesce("error", F.lit("")).alias("error"), F.coalesce(F.size("record"), F.lit(-1)).alias("fields"))


@query
def only_documents(spark, d):
    """A run restricted to two keys."""
    return M.only(B.table(spark, d, "documents").select("doc_id", c("source").alias("key")), ["src1", "src7"])


@query
def clean_signature(spark, d):
    """What the cleaning of each document depends on."""
    docs = B.table(spark, d, "documents")
    ranges = F.when(c("lang") == "fr", F.array().cast("array<struct<lo:int,hi:int>>")).otherwise(
        F.array(F.struct(F.lit(1).alias("lo"), (c("doc_id") % 9).cast("int").alias("hi"))))
    end = F.when(c("lang") == "de", (c("n_chars") % 100).cast("int"))
    return docs.select("doc_id", CL.clean_signature(T.content_hash(c("text")), ranges, end).alias("signature"))


def judged_pages(spark, d) -> DataFrame:
    docs = B.extracted(spark, d)
    return docs.select("slot", F.explode(P.split_pages(c("text"))).alias("p")).filter(c("p.page").isNotNull())


@query
def contents_pages(spark, d):
    return judged_pages(spark, d).select(
        "slot", c("p.page").alias("page"), P.looks_like_contents(c("p.lines")).alias("contents_like"))


@query
def index_pages(spark, d):
    return judged_pages(spark, d).select(
        "slot", c("p.page").alias("page"), P.looks_like_index(c("p.lines")).alias("index_like"))


@query
def body_pages(spark, d):
    """Documents as pages: their lines are as long as the paragraphs."""
    docs = B.documents(spark, d)
    return docs.select("doc_id", P.looks_like_body(F.split("text", "\n")).alias("body_like"))


@query
def front_matter(spark, d):
    docs = B.extracted(spark, d).select("slot", F.get(P.front_matter(P.split_pages(c("text"))), F.lit(0)).alias("r"))
    return docs.select("slot", c("r.lo").alias("lo"), c("r.hi").alias("hi"))


@query
def back_matter(spark, d):
    return B.extracted(spark, d).select("slot", P.back_matter(P.split_pages(c("text"))).alias("start"))


@query
def auto_resolve(spark, d):
    docs = B.resolved(B.extracted(spark, d))
    first = F.get("skip_pages", F.lit(0))
    return docs.select("slot", first["lo"].alias("lo"), first["hi"].alias("hi"), "body_end_page")


# ---- extraction -------------------------------------------------------------


@query
def pages_in_span(spark, d):
    pages = pdf_pages(spark, d)
    documents = spans(spark, d).select(
        F.concat("pdf", F.lit("_"), c("nth").cast("string")).alias("key"), "pdf", "lo", "hi", F.length("title").alias("page_offset")
    )
    return G.pages_in_span(documents, pages).select("key", "page", "printed", F.md5("text").alias("text_md5"))


@query
def ocr_needed(spark, d):
    pages = B.extracted(spark, d).select(c("slot").alias("key"), F.explode(P.split_pages(c("text"))).alias("p"))
    return G.text_layer(pages.select("key", F.array_join("p.lines", "\n").alias("text")))


@query
def extract_status(spark, d):
    docs = B.table(spark, d, "documents")
    fresh = F.md5("text")
    rows = docs.select(
        c("doc_id").cast("string").alias("key"),
        (c("lang") != "es").alias("has_pdf"),
        (~c("source").isin("src1", "src2")).alias("has_text"),
        F.when(c("source") == "src3", None).when(c("source") == "src4", "changed").otherwise(fresh).alias("pdf_hash"),
        fresh.alias("file_hash"),
        (c("n_chars") < 120).alias("needs_ocr"),
    )
    return G.extract_status(rows)


@query
def content_hash(spark, d):
    docs = B.table(spark, d, "documents")
    return docs.select("doc_id", T.content_hash(F.replace("text", F.lit("\n"), F.lit("\r\n"))).alias("hash"))


# ---- cleaning ---------------------------------------------------------------


def steps(spark, d) -> DataFrame:
    return CL.clean(B.resolved(B.extracted(spark, d)), keep_steps=True)


@query
def trim_matter(spark, d):
    return steps(spark, d).select("slot", c("_trim.dropped").alias("dropped"), P.join_pages(c("_trim.pages")).alias("text"))


# Characters that are folded, deleted or decomposed, in the order of their expected forms in the SQL.
ODD_CHARACTERS = (
    0x2018, 0x201C, 0x201D, 0x2013, 0x2014, 0x2010, 0x2011, 0x00AD, 0x200B, 0xFEFF, 0x00A0, 0x2003, 0x2032,
    0xFB00, 0xFB03, 0xFF21, 0x2460, 0x00B2, 0x2122, 0x00B5, 0x212B, 0x0132, 0x3000, 0x2026, 0x01C4, 0x33A5,
)


@query
def normalize_text(spark, d):
    """All extracted texts, each with another odd character at its end."""
    odd = F.array(*(F.lit(chr(x)) for x in ODD_CHARACTERS))
    mark = F.element_at(odd, (c("slot") % len(ODD_CHARACTERS) + 1).cast("int"))
    return B.extracted(spark, d).select("slot", T.normalize(F.concat("text", F.lit("|"), mark, F.lit("|"))).alias("text"))


@query
def is_prose(spark, d):
    docs = B.documents(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return docs.select("doc_id", "n", T.is_prose(c("line")).alias("prose"), F.round(T.alpha_ratio(c("line")), 9).alias("ratio"))


@query
def banner_filter(spark, d):
    return steps(spark, d).select("slot", F.array_join("_lines", "\n").alias("text"))


@query
def running_headers(spark, d):
    return steps(spark, d).select("slot", F.explode(CL.running_headers(c("_lines"))).alias("header"))


@query
def page_furniture(spark, d):
    return steps(spark, d).select("slot", P.join_pages(c("_swept")).alias("text"))


@query
def lift_captions(spark, d):
    return steps(spark, d).select("slot", CL.count_captions(c("_swept")).alias("moved"), c("_lifted").alias("text"))


@query
def hyphen_lexicon(spark, d):
    return steps(spark, d).select("slot", F.explode(CL.hyphen_lexicon(c("_lifted"))).alias("word"))


@query
def fix_hyphenation(spark, d):
    return steps(spark, d).select("slot", c("_whole.joined").alias("joined"), c("_whole.text").alias("text"))


@query
def drop_junk(spark, d):
    return steps(spark, d).select("slot", F.transform("_sound", T.rstrip).alias("_s")).select(
        "slot", F.array_join("_s", "\n").alias("text"))


@query
def reflow(spark, d):
    return steps(spark, d).select("slot", CL.reflow(c("_sound")).alias("text"))


@query
def collapse_blanks(spark, d):
    return steps(spark, d).select("slot", F.array_join("_out", "\n").alias("text"))


@query
def clean_text(spark, d):
    return B.cleaned(spark, d).select("slot", "clean_text")


@query
def clean_stats(spark, d):
    return B.cleaned(spark, d).select("slot", "stats.*")


# ---- sections and chunks ----------------------------------------------------


@query
def book_headings(spark, d):
    lines = B.extracted(spark, d).filter(c("kind") != "article").select("slot", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return lines.select("slot", "n", S.book_heading(c("line")).alias("h")).filter(c("h").isNotNull()).select("slot", "n", "h.*")


@query
def parse_sections(spark, d):
    docs = B.cleaned(spark, d).select("slot", F.posexplode(S.parse_sections(c("clean_text"), c("kind"))).alias("sec", "s"))
    return docs.select(
        "slot", "s.chapter", "s.section", c("s.title").alias("section_title"),
        F.posexplode("s.blocks").alias("_b", "b"),
    ).select("slot", "chapter", "section", "section_title", (c("_b") + 1).alias("b"), "b.text", "b.page_start", "b.page_end")


@query
def paper_headings(spark, d):
    docs = B.cleaned(spark, d).filter(c("kind") == "article").select(
        "slot", F.explode(S.parse_sections(c("clean_text"), c("kind"))).alias("s"))
    return docs.filter(c("s.section").isNotNull()).select(
        "slot", "s.chapter", "s.section", c("s.title").alias("section_title"), F.size("s.blocks").alias("n_blocks"))


@query
def token_count(spark, d):
    return B.documents(spark, d).select("doc_id", T.token_count(c("text")).alias("n_tokens"))


@query
def split_sentences(spark, d):
    docs = B.documents(spark, d).select("doc_id", F.posexplode(F.split("text", K.SENTENCE_GAP)).alias("n", "sentence"))
    return docs.select("doc_id", "n", F.md5("sentence").alias("sentence_md5"))


@query
def pack_chunks(spark, d):
    return B.chunks(spark, d)


@query
def chunk_ids(spark, d):
    return B.chunks(spark, d).groupBy("book").agg(
        F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n"))


@query
def token_quantiles(spark, d):
    return K.token_quantiles(B.chunks(spark, d))


# ---- index maintenance ------------------------------------------------------


def registry_with_chunks(spark, d) -> DataFrame:
    return B.registry(spark, d, F.when(c("lang") == "es", 0).otherwise(F.size(F.split("text", "\n"))).alias("chunks"))


def signatures(spark, d) -> DataFrame:
    docs = B.table(spark, d, "documents")
    return docs.select(F.concat(F.lit("doc_"), c("doc_id").cast("string")).alias("key"), F.md5("text").alias("sig"), "lang")


@query
def stale_docs(spark, d):
    now = signatures(spark, d)
    manifest = now.filter(c("lang") != "es").select(
        "key", F.when(c("lang") == "fr", "old").otherwise(c("sig")).alias("sig"))
    return M.stale(now, manifest).select("key", "sig")


@query
def stale_stages(spark, d):
    """Which stage has to run where titles (fr) or texts (es) have changed and German documents are new."""
    docs = B.table(spark, d, "documents")
    first = F.element_at(F.split("text", "\n"), 1)

    def stamps(title, text):
        clean = F.md5(text)
        return docs.select(F.concat("source", F.lit("-"), "doc_id").alias("key"), "lang", clean.alias("clean"), F.md5(F.concat_ws("|", clean, title)).alias("chunk"))

    before = stamps(F.when(c("lang") == "fr", "old").otherwise(first), F.when(c("lang") == "es", F.upper("text")).otherwise(c("text"))).where("lang <> 'de'")
    return M.stale_stages(stamps(first, c("text")), {s: before.select("key", c(s).alias("stamp")) for s in ("clean", "chunk")})


@query
def index_signature(spark, d):
    docs = B.documents(spark, d)
    rows = docs.select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).select(
        c("source").alias("book"), (c("doc_id") * 1000 + c("n")).alias("id"), c("line").alias("embed_text"))
    return M.index_signature(rows)


@query
def manifest_upsert(spark, d):
    reg = registry_with_chunks(spark, d)
    old = reg.select("slot", "key", F.lit("old").alias("sig"))
    new = reg.filter(c("kind") == "article").select("slot", "key", F.md5("title").alias("sig"))
    return M.upsert(old, new, ["slot"])


@query
def replace_document(spark, d):
    """Turns of conversations that mention 'tion' somewhere, those with it in capitals; the others of them go."""
    turns = B.table(spark, d, "conversations").select(c("conv_id").alias("book"), c("turn").alias("id"), "text")
    fresh = turns.filter(c("text").contains("tion")).select("book", "id", F.upper("text").alias("text"))
    return M.replace_documents(turns, fresh)


@query
def upsert_points(spark, d):
    events = B.table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    return M.latest(events, "user_id", "event_id")


@query
def remove_document(spark, d):
    docs = B.table(spark, d, "documents").select(c("doc_id").alias("id"), c("source").alias("book"))
    gone = B.table(spark, d, "documents").groupBy(c("source").alias("key")).agg(F.sum("n_chars").alias("n")).filter(c("n") % 2 == 0)
    return M.remove_documents(docs, gone)


@query
def purgeable_files(spark, d):
    reg = B.table(spark, d, "documents").select(c("doc_id").alias("key"), c("source").alias("pdf"), "lang")
    reg = reg.withColumn("pdf", F.concat("pdf", F.lit("/"), "lang"))
    return M.purgeable(reg, reg.filter(c("lang") == "de").select("key"))


@query
def unregistered(spark, d):
    files = B.table(spark, d, "pages").select(T.source_label(c("url")).alias("path")).distinct()
    reg = B.table(spark, d, "pages").filter(c("url").contains("/en/")).select(T.source_label(c("url")).alias("pdf"))
    return M.unregistered(files, reg)


@query
def embed_points(spark, d):
    """Vectors of all documents, the dense one as a text of whole numbers."""
    docs = B.documents(spark, d).select("doc_id", c("text").alias("embed_text"))
    return embed(docs).select(
        "doc_id", F.array_join(F.transform("dense", lambda x: x.cast("int").cast("string")), ",").alias("dense"),
        F.size("terms").alias("n_terms"), F.aggregate("weights", F.lit(0.0), lambda a, x: a + x).cast("bigint").alias("n_words"),
    )


# ---- retrieval --------------------------------------------------------------


def points(spark, d) -> DataFrame:
    """Every document as one passage, with its vectors."""
    reg = B.registry(spark, d, "text")
    return embed(
        reg.select(
            c("slot").alias("id"), c("key").alias("book"), c("title").alias("book_title"), "kind",
            F.concat(F.lit("Journal of Tests / "), "source").alias("source"),
            F.lit(None).cast("int").alias("chapter"), F.lit(None).cast("string").alias("section"),
            F.lit("abstract").alias("section_title"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"),
            T.token_count(c("text")).alias("n_tokens"), "text",
        ),
        "text",
    )


def asked(spark, d) -> DataFrame:
    return B.table(spark, d, "benchmark").select(c("item_id").alias("qid"), "text")


@query
def dense_topk(spark, d):
    """The 10 vectors closest to the mean vector of each label."""
    vectors = B.table(spark, d, "embeddings")
    pts = vectors.select(c("vec_id").alias("id"), c("embedding").alias("dense"))
    return R.nearest(pts, label_means(vectors), 10, sparse=False).select("qid", "id", "score", "rank")


def label_means(vectors):
    return (
        vectors.select("label", F.posexplode("embedding").alias("j", "v"))
        .groupBy("label", "j").agg(F.avg(c("v").cast("double")).alias("m"))
        .groupBy("label").agg(F.sort_array(F.collect_list(F.struct("j", "m"))).alias("ms"))
        .select(c("label").cast("bigint").alias("qid"), F.transform("ms", lambda x: x["m"]).alias("dense"))
    )


@query
def dense_cells(spark, d):
    """The same through cells around pivots, of which only those within reach are read."""
    from quire.operators.pruned import cells, dense_search

    vectors = B.table(spark, d, "embeddings")
    pts = vectors.select(c("vec_id").alias("id"), c("embedding").alias("dense"))
    hits, _ = dense_search(cells(pts, dim=64), label_means(vectors), 10)
    return hits


@query
def sparse_blocks(spark, d):
    """The 10 documents of the largest sparse score for each benchmark text, through postings with block bounds."""
    from quire.operators.pruned import postings, sparse_search

    hits, _ = sparse_search(postings(points(spark, d)), R.encode_queries(asked(spark, d)), 10)
    return hits


@query
def sparse_topk(spark, d):
    return R.nearest(points(spark, d), R.encode_queries(asked(spark, d)), 10, dense=False).select("qid", "id", "score", "rank")


@query
def rrf_fusion(spark, d):
    ranked = R.nearest(points(spark, d), R.encode_queries(asked(spark, d)), 30)
    return R.fuse(ranked, 5).select("qid", "id", F.round("score", 9).alias("score"), "rank")


@query
def hybrid_search(spark, d):
    """All benchmark texts against all documents: filter-free hybrid search with rerank."""
    return answer_columns(R.search(points(spark, d), asked(spark, d)))


@query
def filtered_search(spark, d):
    """The same restricted to articles of one source, matched by its words."""
    return answer_columns(R.search(points(spark, d), asked(spark, d), kind="article", source="tests SRC3", rerank_hits=False))


def answer_columns(hits: DataFrame) -> DataFrame:
    extra = [F.round("rerank_score", 9).alias("rerank_score")] if "rerank_score" in hits.columns else []
    return hits.select("qid", "id", "book", "kind", F.round("score", 9).alias("score"), *extra, "rank")


@query
def rerank_topk(spark, d):
    """The 3 documents per benchmark text with most of its words, among the sparse top 30."""
    pts = points(spark, d)
    found = R.nearest(pts, R.encode_queries(asked(spark, d)), 30, dense=False)
    hits = found.join(pts.select("id", "text"), "id").join(asked(spark, d).select("qid", c("text").alias("query")), "qid")
    return R.rerank(hits, 3).select("qid", "id", F.round("rerank_score", 9).alias("rerank_score"), "rank")


@query
def source_match(spark, d):
    pages = B.table(spark, d, "pages").select("page_id", T.source_label(c("url")).alias("source"))
    return pages.filter(R.source_matches(c("source"), F.lit("example EN")))


@query
def cite(spark, d):
    return B.chunks(spark, d).select("id", R.cite_row().alias("cite"))


@query
def hit_preview(spark, d):
    return B.chunks(spark, d).select("id", R.preview(c("text")).alias("preview"))


@query
def render_hits(spark, d):
    """Benchmark texts answered by both branches without reranking, rendered per query."""
    k, n = CT.tool_limits(4)
    hits = R.search(points(spark, d), asked(spark, d), k=k, candidates=n, rerank_hits=False)
    return CT.answer_queries(asked(spark, d), CT.render_hits(hits))


@query
def read_context(spark, d):
    """Each document's first chunk with its neighbours in the section."""
    pts = B.chunks(spark, d).drop("embed_text")
    anchors = B.registry(spark, d).select((c("slot") * 1048576).alias("chunk_id"))
    return CT.context(pts, anchors, before=1, after=9).select("chunk_id", "id", "requested")


# ---- catalog ----------------------------------------------------------------


@query
def catalog_summary(spark, d):
    reg = registry_with_chunks(spark, d)
    return CT.catalog_summary(CT.list_documents(reg.withColumn("sig", F.lit("")), reg))


@query
def catalog_by_source(spark, d):
    reg = registry_with_chunks(spark, d)
    return CT.catalog_by_source(CT.list_documents(reg.limit(0), reg), "RC1")


@query
def list_documents(spark, d):
    reg = registry_with_chunks(spark, d)
    return CT.list_documents(reg.filter(c("source") == "none"), reg)


@query
def status_rollup(spark, d):
    reg = registry_with_chunks(spark, d)
    return CT.status_rollup(reg.withColumn("source", F.when(c("source") == "src0", "").otherwise(c("source"))))


@query
def kind_histogram(spark, d):
    return CT.kind_histogram(B.registry(spark, d))


@query
def history_window(spark, d):
    return CT.history_window(B.table(spark, d, "conversations"))
