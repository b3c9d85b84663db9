"""Near-duplicates by SimHash, searched with BK-trees."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quire.llm.components import components
from quire.llm.store import stored

c = F.col
SEED = 42
PIECE = 1 << 15  # shingles whose bits are counted at once


def signature(hashes: np.ndarray) -> int:
    """The 64-bit SimHash of unsigned 64-bit hashes as a signed long: a bit is set if over half of them have it."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), PIECE):
        part = hashes[i:i + PIECE].astype("<u8", copy=False)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of a text as a signed long.

    A-Z is lower-cased, words are runs of anything but ASCII white space, and
    every shingle of ``shingle`` words counts, repeats included. A text with
    fewer words is one shingle; without words the fingerprint is zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line, n = b" ".join(words), min(shingle, len(words))
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    spans = zip(starts, ends[n - 1:], strict=False)
    return signature(np.fromiter((xxh64_intdigest(line[a:b - 1], SEED) for a, b in spans), "<u8"))


def fingerprints(df: DataFrame, text: str = "text", shingle: int = 3) -> DataFrame:
    """``df`` without its text, with ``fp`` (long); a null text has fingerprint zero."""
    keep = [x for x in df.columns if x != text]
    schema = df.select(*keep).withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([fingerprint(x.as_py(), shingle) for x in b.column(text)], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in keep), found], [*keep, "fp"])

    return df.mapInArrow(run, schema)


def hex16(fp: str) -> F.Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


class BKTree:
    """Fingerprints in a tree: a child hangs on the edge of its distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.edges: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        """Adds a value that the tree does not hold yet."""
        new = len(self.values)
        self.values.append(value)
        self.edges.append({})
        if not new:
            return
        node = 0
        while True:
            d = (self.values[node] ^ value).bit_count()
            following = self.edges[node].setdefault(d, new)
            if following == new:
                return
            node = following

    def within(self, value: int, radius: int) -> Iterable[int]:
        """Positions of the values at most ``radius`` bits away, following only edges within the radius."""
        stack = [0] if self.values else []
        while stack:
            node = stack.pop()
            d = (self.values[node] ^ value).bit_count()
            if d <= radius:
                yield node
            edges = self.edges[node]
            if len(edges) <= 2 * radius + 1:
                stack += [child for edge, child in edges.items() if -radius <= edge - d <= radius]
            else:
                stack += [edges[e] for e in range(d - radius, d + radius + 1) if e in edges]


def near_matrix(values: np.ndarray, radius: int) -> np.ndarray:
    """Which two of the fingerprints are within the radius; each distinct one is searched in the tree of those before it."""
    distinct, of = np.unique(values.view(np.uint64), return_inverse=True)
    tree, near = BKTree(), np.eye(len(distinct), dtype=bool)
    for i, value in enumerate(distinct.tolist()):
        for j in tree.within(value, radius):
            near[i, j] = near[j, i] = True
        tree.add(value)
    return near[np.ix_(of, of)]


def links(values: list[int], ids: list[int], asked: list[bool], radius: int) -> list[tuple[int, int]]:
    """Links that connect what a shard's fingerprints within the radius connect.

    With ``asked`` all false every value is searched in the tree of those before
    it; else the false ones form the tree and the true ones are searched in it.
    Gives a spanning star per connected set, not all pairs.
    """
    parent = list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    tree, members, split = BKTree(), [], any(asked)
    order = sorted(range(len(values)), key=lambda i: asked[i])
    for i in order:
        if not split or asked[i]:
            for j in tree.within(values[i], radius):
                parent[root(i)] = root(members[j])
        if not asked[i]:
            members.append(i)
            tree.add(values[i])
    return [(ids[i], ids[root(i)]) for i in range(len(values)) if parent[i] != i]


def shard_keys(fp: str, radius: int) -> F.Column:
    """Array of shard keys: equal in at least one place for fingerprints within the radius.

    64 bits are cut into ``radius + 2`` bands; ``radius`` differing bits leave
    two of them untouched, so every pair of bands with its bits is a key.
    """
    n = radius + 2
    cuts = [64 * i // n for i in range(n + 1)]
    band = [F.shiftrightunsigned(c(fp), cuts[i]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1)) for i in range(n)]
    pairs = list(combinations(range(n), 2))
    return F.array(*(
        F.struct(F.lit(k).alias("pair"), band[i].alias("x"), band[j].alias("y")) for k, (i, j) in enumerate(pairs)
    ))


def near_links(reps: DataFrame, radius: int = 3, shard: int = 2048, bucket: int = 50_000) -> DataFrame:
    """``a, b``: links between distinct fingerprints ``rep, fp`` within the radius.

    Fingerprints meet in shards of equal band pairs. A shard is one BK-tree; one
    with more than ``shard`` members is cut into chunks and each pair of chunks
    is searched on its own, so a shard of any size is spread over tasks.
    """
    keyed = stored(reps.select("rep", "fp", F.explode(shard_keys("fp", radius)).alias("key")), "shards")
    sizes = keyed.groupBy("key").count().where("count > 1")
    crowded = F.ceil(c("count") / shard)
    chunk = F.pmod(F.xxhash64("fp"), c("chunks"))
    cells = (
        keyed.join(sizes, "key").withColumn("chunks", crowded).withColumn("own", chunk)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), c("chunks") - 1)))
        .select(
            "rep", "fp", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
            (c("own") > c("other")).alias("asked"),
        )
    )
    rows = keyed.count()
    buckets = max(1, -(-rows // bucket))
    cells = cells.select(
        "rep", "fp", "asked", F.xxhash64("key", "i", "j").alias("cell"),
    ).withColumn("bucket", F.pmod("cell", F.lit(buckets)))

    def search(table: pa.Table) -> pa.Table:
        cell, rep, fp = (table[x].to_numpy() for x in ("cell", "rep", "fp"))
        asked = table["asked"].to_numpy(zero_copy_only=False)
        order = np.argsort(cell, kind="stable")
        cell, rep, fp, asked = cell[order], rep[order], fp.view(np.uint64)[order], asked[order]
        edges = np.flatnonzero(np.diff(cell)) + 1
        bounds = np.concatenate([[0], edges, [len(cell)]])
        found: list[tuple[int, int]] = []
        for k in np.flatnonzero(np.diff(bounds) > 1):
            a, b = bounds[k], bounds[k + 1]
            if b - a == 2:  # a tree of one node
                if (int(fp[a]) ^ int(fp[a + 1])).bit_count() <= radius:
                    found.append((int(rep[a]), int(rep[a + 1])))
                continue
            found += links(fp[a:b].tolist(), rep[a:b].tolist(), asked[a:b].tolist(), radius)
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return cells.groupBy("bucket").applyInArrow(search, "a long, b long").where("a <> b").distinct()


def near_duplicates(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3,
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    Fingerprints that differ in ``radius`` bits or fewer link their documents;
    the component is the smallest document id reachable. Equal fingerprints are
    searched once. Fingerprints of the same bands meet in a shard's BK-tree, in
    the task that holds the shard: broadcasting every tree to every task would
    make the broadcast grow with the corpus.

    A null text or one without words has fingerprint zero and links like any
    other. A repeated row is repeated in the result. A row with a null id makes
    no links; its component is that of the documents with its fingerprint, null
    if there are none. Other columns of ``df`` are ignored.
    """
    rows = df.select(c(doc_id).cast("long").alias("doc_id"), c(text).alias("text"))
    prints = stored(fingerprints(rows, "text", shingle), "prints")
    reps = stored(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    linked = components(near_links(reps, radius))
    # rows that repeat an id with other texts link the fingerprints of that id
    several = prints.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y")
    same = stored(prints.join(several, "doc_id", "left_semi").join(reps, "fp").select(c("doc_id").alias("a"), c("rep").alias("b")), "same")
    if not same.isEmpty():
        linked = components(same.unionByName(linked.select(c("node").alias("a"), c("component").alias("b"))))
    classes = reps.join(linked, c("rep") == c("node"), "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(classes, "fp", "left").select(
        "doc_id", hex16("fp").alias("fingerprint"), "component_id")
