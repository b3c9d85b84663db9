"""Files that tasks open themselves, by byte ranges, in any file system pyarrow reaches."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from hashlib import md5
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.frames import small

c = F.col
BLOCK = 4 << 20  # bytes that are hashed at once
TASK = 128 << 20  # bytes that a task is given


def listing(spark: SparkSession, root: str, suffix: str = "*") -> DataFrame:
    """``path`` below ``root``, ``uri`` in full, ``length`` and ``content`` of files; only what is selected is read.

    Spark's file source passes over files without bytes.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", suffix).load(root)
        .withColumnRenamed("path", "uri"))
    # what stands behind the root is kept, compared as plain text
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString().rstrip("/") + "/"
    behind = F.when(F.startswith("uri", F.lit(base)), F.substr("uri", F.lit(len(base) + 1)))
    return files.withColumn("path", F.coalesce(behind, "uri"))


def located(files: DataFrame, root: str) -> DataFrame:
    """``path, uri, length`` of the files that the column ``path`` of ``files`` names; none is opened."""
    found = listing(files.sparkSession, root).select("path", "uri", "length")
    return found.join(small(files.select("path").distinct()), "path", "left_semi")


class Source:
    """A file as an engine gets it: to be read by ranges, or as a name on the local disk."""

    def __init__(self, uri: str):
        self.uri = uri
        self.path = uri[len("file:"):] if uri.startswith("file:") else uri if "://" not in uri else None
        if self.path is not None:
            self.path = "/" + self.path.lstrip("/")

    def open(self) -> BinaryIO:
        from pyarrow import fs

        if self.path is not None:
            return fs.LocalFileSystem().open_input_file(self.path)
        system, path = fs.FileSystem.from_uri(quote(self.uri, safe=":/@%"))
        return system.open_input_file(path)

    @contextmanager
    def local(self) -> Iterator[str]:
        """A local file with the same bytes: itself, or a copy in the task's scratch folder, made block by block."""
        if self.path is not None:
            yield self.path
            return
        with tempfile.NamedTemporaryFile() as copy, self.open() as file:
            shutil.copyfileobj(file, copy, BLOCK)
            copy.flush()
            yield copy.name


def spread(rows: DataFrame, size: str, *keys: str, task: int = TASK) -> DataFrame:
    """``rows`` dealt out by ``keys`` so that a task gets about ``task`` of the sum of ``size``, and all cores get some.

    Rows are narrow here and what they cost is not in them, so their number of
    partitions is fixed: it is not for adaptive execution to merge them.
    """
    total = rows.agg(F.sum(size)).first()[0] or 0
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(cores, -(-int(total) // task)), *keys)


def content_hashes(files: DataFrame, block: int = BLOCK) -> DataFrame:
    """``path, file_hash`` of files given as ``path, uri, length``.

    Every block of ``block`` bytes is hashed where a task reads it, and the
    hash of a file is that of its blocks' hashes in order, so a file of any
    size is spread over tasks and never one value. A file of a single block has
    the MD5 of its bytes. A file that cannot be read has no hash.
    """
    parts = files.select("path", "uri", "length", F.explode(F.expr(
        f"sequence(0L, greatest(0L, (length - 1) div {block}))")).alias("nth")).withColumn("size", F.lit(block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for uri, length, nth in zip(*(b.column(x).to_pylist() for x in ("uri", "length", "nth")), strict=True):
                try:
                    with Source(uri).open() as file:
                        file.seek(nth * block)
                        want = min(block, length - nth * block)
                        data = file.read(want)
                        out.append(md5(data).hexdigest() if len(data) == want else None)
                except OSError:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("nth"), pa.array(out, pa.string())], ["path", "nth", "digest"])

    hashed = spread(parts, "size", "path", "nth").select("path", "uri", "length", "nth").mapInArrow(run, "path string, nth long, digest string")
    # 40 bytes a block: a file of a terabyte gathers ten megabytes
    whole = hashed.groupBy("path").agg(
        F.sort_array(F.collect_list(F.struct("nth", "digest"))).alias("blocks"), F.bool_and(c("digest").isNotNull()).alias("good"))
    many = F.md5(F.array_join(F.transform("blocks", lambda x: x["digest"]), ""))
    return whole.select("path", F.when(c("good"), F.when(F.size("blocks") == 1, c("blocks")[0]["digest"]).otherwise(many)).alias("file_hash"))
