"""Page sources: files on disk, page readers, marked text."""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import schemas
from quire.functions import text as T
from quire.functions.frames import durable, small, stored
from quire.operators import pages as P
from quire.sources.files import BLOCK, Source, listing, located, spread

c = F.col
SHARE = 64 << 20  # bytes of a file whose pages one task reads


def scan_files(spark: SparkSession, root: str, suffix: str = "*.pdf") -> DataFrame:
    """``path, length`` of the files below ``root``; contents are not read."""
    return listing(spark, root, suffix).select("path", "length")


class OpenFile(Protocol):
    """A file an engine has opened: pages from 1, the outline, and the type on a page."""

    page_count: int

    def text(self, page: int) -> str: ...

    def toc(self) -> list[tuple[int, str, int]]:
        """``(level, title, page)`` of the outline, empty if there is none."""
        ...

    def spans(self, page: int) -> list[tuple[float, float, float, str]]:
        """``(size, x, y, text)`` of the pieces of type on a page, empty if unknown."""
        ...


Engine = Callable[[Source], AbstractContextManager]


@contextmanager
def open_with_pymupdf(source: Source) -> Iterator[OpenFile]:
    import pymupdf

    class Opened:
        def __init__(self, doc) -> None:
            self.doc, self.page_count = doc, doc.page_count

        def text(self, page: int) -> str:
            return self.doc[page - 1].get_text("text")

        def toc(self) -> list[tuple[int, str, int]]:
            return [tuple(x[:3]) for x in self.doc.get_toc()]

        def spans(self, page: int) -> list[tuple[float, float, float, str]]:
            blocks = self.doc[page - 1].get_text("dict")["blocks"]
            return [
                (s["size"], *s["origin"], s["text"])
                for b in blocks for line in b.get("lines", []) for s in line["spans"]
            ]

    with source.local() as name, pymupdf.open(name, filetype="pdf") as doc:
        yield Opened(doc)


@contextmanager
def open_with_pdftotext(source: Source) -> Iterator[OpenFile]:
    """Text only, page by page."""
    if not shutil.which("pdftotext"):
        raise RuntimeError("pdftotext is not on PATH")
    with source.local() as name:
        told = subprocess.run(["pdfinfo", name], check=True, capture_output=True).stdout.decode("utf-8", "replace")

        class Opened:
            page_count = int(next(x.split(":")[1] for x in told.splitlines() if x.startswith("Pages:")))

            def text(self, page: int) -> str:
                done = subprocess.run(["pdftotext", "-layout", "-f", str(page), "-l", str(page), name, "-"], check=True, capture_output=True)
                return done.stdout.decode("utf-8", "replace").removesuffix("\f")

            def toc(self) -> list:
                return []

            def spans(self, page: int) -> list:
                return []

        yield Opened()


@contextmanager
def open_formfeed(source: Source) -> Iterator[OpenFile]:
    """Plain text whose pages end in form feeds; a page is read where it stands, the rest is passed over in blocks."""
    with source.open() as file:
        ends, at = [0], 0
        while block := file.read(BLOCK):
            ends += (np.flatnonzero(np.frombuffer(block, np.uint8) == 12) + at + 1).tolist()
            at += len(block)
        if at > ends[-1]:
            ends.append(at + 1)

        class Opened:
            page_count = len(ends) - 1

            def text(self, page: int) -> str:
                file.seek(ends[page - 1])
                return file.read(ends[page] - ends[page - 1] - 1).decode("utf-8", "replace")

            def toc(self) -> list:
                return []

            def spans(self, page: int) -> list:
                return []

        yield Opened()


ENGINES: dict[str, Engine] = {"pymupdf": open_with_pymupdf, "pdftotext": open_with_pdftotext, "formfeed": open_formfeed}
STRUCTURE = (
    "path string, page_count int, toc array<struct<ord:int,level:int,title:string,page:int>>, "
    "heads array<struct<page:int,text:string,spans:array<struct<size:double,x:double,y:double,text:string>>>>, error string"
)


def engine_of(engine: str | Engine) -> Engine:
    return ENGINES[engine] if isinstance(engine, str) else engine


def read_structure(files: DataFrame, root: str, engine: str | Engine = "pymupdf") -> DataFrame:
    """``path, page_count, toc, heads, error`` of the files that ``path`` names, each opened once.

    ``heads`` has text and type of page one and of the pages that the outline
    points to at its top level: what titles and folios are found in. A file
    that cannot be read gives one row with the error.
    """
    opened = engine_of(engine)

    def found(file: OpenFile) -> tuple:
        toc = [(i, level, title, page) for i, (level, title, page) in enumerate(file.toc())]
        top = min((x[1] for x in toc), default=0)
        pages = sorted({1} | {p for _, level, _, p in toc if level == top and p and 0 < p <= file.page_count})
        return file.page_count, toc, [(p, file.text(p), file.spans(p)) for p in pages if p <= file.page_count]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                try:
                    with opened(Source(row.uri)) as file:
                        out = (row.path, *found(file), None)
                except Exception as exc:  # noqa: BLE001 - reported per file
                    out = (row.path, None, None, None, f"{type(exc).__name__}: {exc}")
                yield pd.DataFrame([out], columns=["path", "page_count", "toc", "heads", "error"])

    return spread(located(files, root), "length", "path").mapInPandas(run, STRUCTURE)


def shares(files: DataFrame, share: int = SHARE) -> DataFrame:
    """``files`` (with ``length``), a row for each ``part`` of ``parts``, so that a part is about ``share`` bytes."""
    parts = F.greatest(F.lit(1).cast("long"), F.ceil(c("length") / share))
    return files.withColumn("parts", parts).withColumn("part", F.explode(F.expr("sequence(0L, parts - 1)")))


def own_pages(wanted: list[tuple[int, int]] | None, page_count: int, part: int, parts: int) -> list[int]:
    """The pages of one part: the wanted ones in order, dealt out in runs of equal length."""
    pages = range(1, page_count + 1)
    if wanted is not None:
        pages = sorted({p for lo, hi in wanted for p in range(max(1, lo), min(hi, page_count) + 1)})
    return list(pages[len(pages) * part // parts:len(pages) * (part + 1) // parts])


def read_pages(files: DataFrame, root: str, engine: str | Engine = "pymupdf", share: int | None = None) -> DataFrame:
    """``pdf, page, text, error`` for rows of ``path[, wanted]``: a file's pages, or one row with its error.

    ``wanted`` is an array of page ranges ``lo, hi``; without it all pages are
    read. Only the files asked for are opened, in the tasks, and a large file is
    dealt out: each of its parts opens it for itself and reads a run of its
    pages. A page that cannot be read fails the file as a whole: none of its
    pages is given, whichever task read them.
    """
    opened, share = engine_of(engine), share or SHARE
    found = located(files, root)
    if "wanted" in files.columns:
        found = found.join(small(files.select("path", "wanted")), "path")
    else:
        found = found.withColumn("wanted", F.lit(None).cast("array<struct<lo:int,hi:int>>"))
    parts = shares(found, share).withColumn("size", F.floor(c("length") / c("parts")))
    columns = ["pdf", "page", "text", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                rows: list[tuple] = []
                try:
                    with opened(Source(row.uri)) as file:
                        wanted = None if row.wanted is None else [(r["lo"], r["hi"]) for r in row.wanted]
                        for p in own_pages(wanted, file.page_count, row.part, row.parts):
                            rows.append((row.path, p, file.text(p), None))
                            if len(rows) == 64:
                                yield pd.DataFrame(rows, columns=columns)
                                rows = []
                except Exception as exc:  # noqa: BLE001 - reported per file
                    rows.append((row.path, None, None, f"{type(exc).__name__}: {exc}"))
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    dealt = spread(parts, "size", "path", "part", task=2 * share)
    read = stored(dealt.mapInPandas(run, schemas.PAGES + ", error string"), "pages")
    failed = read.where("error is not null").groupBy("pdf").agg(F.min("error").alias("error"))
    whole = read.where("error is null").join(small(failed.select("pdf")), "pdf", "left_anti")
    return whole.unionByName(failed.select("pdf", F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("text"), "error"))


def formfeed_pages(texts: DataFrame) -> DataFrame:
    """``pdf, page, text`` of whole texts whose pages end in form feeds."""
    return texts.select(
        "pdf", (F.coalesce("first", F.lit(1))).alias("_first"), F.posexplode(F.split("text", "\f")).alias("_n", "text")
    ).select("pdf", (F.col("_first") + F.col("_n")).alias("page"), "text")


def assemble(documents: DataFrame, pages: DataFrame, engine: str = "pymupdf") -> DataFrame:
    """``key, text``: the marked text of each document from its pages.

    ``pages`` has ``key, page, text``; a document's pages come together here
    because its text is one value everywhere after.
    """
    c = F.col
    bodies = pages.join(documents.select("key", "page_offset"), "key").groupBy("key").agg(
        F.sort_array(
            F.collect_list(
                F.struct("page", P.render_page(c("page"), c("text"), c("page_offset")).alias("body"))
            )
        ).alias("bodies")
    )
    header = P.extraction_header(T.basename(c("pdf")), c("pages"), c("title"), c("page_offset"), engine)
    return documents.join(bodies, "key").select(
        "key", F.concat(header, F.array_join(F.transform("bodies", lambda b: b["body"]), "\n")).alias("text")
    )


def write_marked_text(texts: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``key, text`` as one Parquet table, whatever the number of documents."""
    texts.select("key", "text").write.mode(mode).parquet(path)


def read_marked_text(spark: SparkSession, path: str, registry: DataFrame | None = None) -> DataFrame:
    """``key, text`` of the table at ``path``.

    With a registry, ``path`` is a folder of text files, and the registry's
    ``text`` field (by default the key with ``.txt``) says whose each one is.
    """
    if registry is None:
        return spark.read.schema("key string, text string").parquet(path)
    name = F.coalesce(F.col("text"), F.concat("key", F.lit(".txt"))).alias("path")
    files = listing(spark, path).select("path", F.col("content").cast("string").alias("text"))
    return files.join(small(registry.select("key", name)), "path").select("key", "text")


def remove_marked_text(spark: SparkSession, path: str, keys: DataFrame) -> None:
    """Takes documents (column ``key``) out of the table at ``path``.

    Only files that hold one of them are rewritten. The rest of their rows is
    written before they go, so that a crash loses nothing; run it again then.
    """
    gone = small(keys.select("key").distinct())
    table = read_marked_text(spark, path)
    held = [r[0] for r in table.join(gone, "key", "left_semi").select(F.input_file_name()).distinct().collect()]
    if not held:
        return
    rest = durable(spark.read.schema("key string, text string").parquet(*held).join(gone, "key", "left_anti"))
    rest.write.mode("append").parquet(path)
    for file in held:
        where = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(file))
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, False)


def delete_files(files: DataFrame, root: str) -> int:
    """Deletes the files ``path`` below ``root``, as a purge asks for; gives their number."""
    spark, n = files.sparkSession, 0
    for row in files.select("path").toLocalIterator():
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{row['path']}")
        n += bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, False))
    return n
