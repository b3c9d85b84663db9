"""Substring dedup: seed on winnowed anchors, extend to windows, cut maximal repeats.

A window is ``window`` consecutive words of one document. Its anchor is the
least hash among its runs of ``seed`` words, so equal windows have equal
anchors, and neighbouring windows mostly share one. The work goes in two
rounds of the same kind:

1. seeds: which anchors occur in more than one document,
2. extension: the windows around those anchors, and which of them also start
   in a document with a smaller id.

Maximal repeats are the runs of words that such windows cover. Anchors and
windows travel as packed arrays, once per task and value: what one task holds
several times it settles itself, so a passage that a third of all documents
share weighs one entry per task, not one per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.llm.store import stored
from quire.llm.words import hashed_words, mix, run_hash, slices

c = F.col
FLUSH = 12 << 20  # bytes of text whose anchors a task gathers before it sends them
PACKED = "bucket long, many boolean, docs binary, keys binary, checks binary"
MARKS = "part long, docs binary, keys binary"
RESULT = "kept string, n_words long, n_removed long, repeats array<struct<start:long,end:long>>"


KEY, CHECK = 0xA0761D6478BD642F, 0xE7037ED1A0B428DB
NOTHING = pa.table({"bucket": pa.array([], pa.int64()), "many": pa.array([], pa.bool_()), **{x: pa.array([], pa.binary()) for x in ("docs", "keys", "checks")}})


def part_of(ids: np.ndarray, parts: int) -> np.ndarray:
    """The part that holds a document, as :func:`part_column` has it."""
    return np.mod(ids ^ (ids >> 17), parts)


def part_column(parts: int) -> F.Column:
    own = F.pmod(c("doc_id").bitwiseXOR(F.shiftright("doc_id", 17)), F.lit(parts).cast("long"))
    return F.coalesce(own, F.pmod(F.xxhash64("text"), F.lit(parts).cast("long"))).alias("part")


def anchors(words: np.ndarray, row: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows and the anchor of each."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    seeds = run_hash(words, seed, 0xD6E8FEB86659FD93)
    least = seeds[:n].copy()
    for i in range(1, window - seed + 1):
        np.minimum(least, seeds[i:i + n], out=least)
    starts = np.flatnonzero(row[:n] == row[window - 1:])
    return starts, least[starts]


class Sender:
    """Gathers (document, key) pairs and packs them by bucket, each key once.

    A key held by one document here has to hear from the other tasks. Of a key
    held by several the answer is known, and those marks are sent off directly;
    with ``smaller`` only the first of them asks.
    """

    def __init__(self, buckets: int, parts: int, smaller: bool) -> None:
        self.buckets, self.parts, self.smaller = buckets, parts, smaller
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, docs: np.ndarray, keys: np.ndarray, checks: np.ndarray, size: int) -> None:
        self.held.append((docs, keys, checks))
        self.size += size

    def flush(self) -> Iterator[pa.RecordBatch]:
        docs, keys, checks = (np.concatenate(x) for x in zip(*self.held, strict=True)) if self.held else (np.zeros(0, np.int64),) * 3
        self.held, self.size = [], 0
        if not len(docs):
            return
        order = np.lexsort((docs, checks, keys))
        docs, keys, checks = docs[order], keys[order], checks[order]
        fresh = np.concatenate([[True], (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])])
        other = np.concatenate([[True], fresh[1:] | (docs[1:] != docs[:-1])])  # a pair counts once
        docs, keys, checks, fresh = docs[other], keys[other], checks[other], fresh[other]
        at = np.flatnonzero(fresh)
        sizes = np.diff(np.concatenate([at, [len(docs)]]))
        many = sizes > 1
        if self.smaller:  # all but the first are repeats of a smaller document; the first must ask
            known = ~fresh
            told = np.zeros(len(at), bool)
        else:
            known = np.repeat(many, sizes)
            told = many
        yield from pack_marks(docs[known], keys[known], self.parts, direct=True)
        docs, keys, checks = docs[at], keys[at], checks[at]
        bucket = (keys % np.uint64(self.buckets)).astype(np.int64) * 2 + told
        order = np.argsort(bucket, kind="stable")
        bucket, docs, keys, checks = bucket[order], docs[order], keys[order], checks[order]
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        ends = np.concatenate([cuts[1:], [len(bucket)]])
        yield pa.RecordBatch.from_arrays([
            pa.array(bucket[cuts] // 2), pa.array(bucket[cuts] % 2 == 1), *(
                pa.array([x[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()) for x in (docs, keys, checks)
            )], ["bucket", "many", "docs", "keys", "checks"])


def pack_marks(docs: np.ndarray, keys: np.ndarray, parts: int, direct: bool = False) -> Iterator[pa.RecordBatch]:
    """Marks (document, key) packed by the part that holds the document."""
    if not len(docs):
        return
    part = part_of(docs, parts)
    order = np.argsort(part, kind="stable")
    part, docs, keys = part[order], docs[order], keys[order]
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    ends = np.concatenate([cuts[1:], [len(part)]])
    packed = [pa.array([x[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()) for x in (docs, keys)]
    if direct:  # in the shape of a packed row, with the part below zero instead of a bucket
        none = pa.nulls(len(cuts), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(-1 - part[cuts]), pa.array(np.zeros(len(cuts), bool)), *packed, none],
            ["bucket", "many", "docs", "keys", "checks"])
    else:
        yield pa.RecordBatch.from_arrays([pa.array(part[cuts]), *packed], ["part", "docs", "keys"])


def _joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), kind)


def settle(sent: DataFrame, parts: int, smaller: bool) -> DataFrame:
    """Marks for the pairs whose key other documents hold too (with ``smaller``: a smaller one)."""

    def run(table: pa.Table) -> pa.Table:
        first = table["bucket"][0].as_py()
        if first < 0:  # settled where they were found
            part = pa.array(np.full(table.num_rows, -1 - first))
            return pa.table({"part": part, "docs": table["docs"], "keys": table["keys"]})
        sizes = np.asarray(pa.compute.binary_length(table["docs"]).to_numpy(), np.int64) // 8
        many = np.repeat(table["many"].to_numpy(zero_copy_only=False), sizes)
        docs, keys, checks = _joined(table["docs"], np.int64), _joined(table["keys"], np.uint64), _joined(table["checks"], np.uint32)
        order = np.lexsort((docs, checks, keys)) if smaller else np.lexsort((checks, keys))
        docs, keys, checks, many = docs[order], keys[order], checks[order], many[order]
        fresh = np.concatenate([[True], (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])])
        at = np.flatnonzero(fresh)
        sizes = np.diff(np.concatenate([at, [len(docs)]]))
        if smaller:
            marked = docs > np.repeat(docs[at], sizes)
        else:
            least, most = np.minimum.reduceat(docs, at), np.maximum.reduceat(docs, at)
            shared = (least < most) | np.logical_or.reduceat(many, at)
            marked = np.repeat(shared, sizes) & ~many
        found = list(pack_marks(docs[marked], keys[marked], parts))
        return pa.Table.from_batches(found) if found else pa.table({"part": pa.array([], pa.int64()), "docs": pa.array([], pa.binary()), "keys": pa.array([], pa.binary())})

    return sent.groupBy("bucket").applyInArrow(run, MARKS)


class Marks:
    """The keys marked for the documents of one part."""

    def __init__(self, docs: np.ndarray, keys: np.ndarray) -> None:
        self.pairs = np.sort(mix(docs.view(np.uint64)) ^ keys)

    def hold(self, docs: np.ndarray, keys: np.ndarray) -> np.ndarray:
        if not len(self.pairs) or not len(docs):
            return np.zeros(len(docs), bool)
        pair = mix(docs.view(np.uint64)) ^ keys
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return self.pairs[at] == pair


def read_marks(table: pa.Table) -> tuple[Marks, Marks, set[int]]:
    """Marked keys, copies with the start of their print, and the ids of the copies."""
    copy = table["copy"].to_numpy(zero_copy_only=False)
    own, copies = table.filter(pa.array(~copy)), table.filter(pa.array(copy))
    docs = _joined(copies["docs"], np.int64)
    return (
        Marks(_joined(own["docs"], np.int64), _joined(own["keys"], np.uint64)),
        Marks(docs, _joined(copies["keys"], np.uint64)), set(docs.tolist()),
    )


def is_copy(ids: list, texts: pa.Array, copies: Marks, among: set[int]) -> np.ndarray:
    """Which rows repeat the text of a document with a smaller id."""
    out = np.zeros(len(ids), bool)
    for i, doc in enumerate(ids):
        if doc in among:
            head = hashlib.sha256((texts[i].as_py() or "").encode()).digest()[:8]
            out[i] = copies.hold(np.array([doc]), np.frombuffer(head, np.uint64))[0]
    return out


def repeats(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal repeats: the ranges of words that ascending windows cover."""
    if not len(starts):
        return []
    new = np.flatnonzero(np.diff(starts) > window) + 1
    return list(zip(starts[np.concatenate([[0], new])].tolist(), (starts[np.concatenate([new - 1, [-1]])] + window).tolist(), strict=True))


def substring_dedup(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 13, seed: int = 6,
) -> DataFrame:
    """The columns of ``df`` with ``kept, n_words, n_removed, repeats``.

    A word goes if a window over it also starts in a document with a smaller
    id; windows are judged on the input. ``kept`` has the remaining words,
    joined by one space, ``repeats`` the maximal ranges of words that went.
    Words are runs of anything but ASCII white space.

    A null text has no words. Rows with a null id neither cut nor are cut.
    Rows that repeat an id count as one document with several texts: they do
    not cut each other. Columns of ``df`` named like a result are replaced.

    Windows are compared by 96 bits of hash, so a wrong cut is out of reach.
    """
    new = [x.split()[0] for x in RESULT.split(", ")]
    extra = [x for x in df.columns if x not in (doc_id, text, *new)]
    docs = df.select(
        c(doc_id).cast("long").alias("doc_id"), c(text).alias("text"),
        (F.struct(*(F.col(f"`{x}`") for x in extra)) if extra else F.lit(True)).alias("rest"),
    )
    volume = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts, buckets = volume // (4 << 20) + 1, volume // (16 << 20) + 1
    known = docs.where("doc_id is not null")

    # of identical texts the one with the smallest id speaks for all
    prints = stored(known.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("print")), "prints")
    least = prints.groupBy("print").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = np.frombuffer(b"".join(x.as_py()[:8] for x in b.column("print")), np.uint64)
            yield from pack_marks(b.column("doc_id").to_numpy(), keys, parts)

    copies = stored(
        prints.join(least, "print").where("doc_id > first").select("doc_id", "print").distinct()
        .mapInArrow(pack, MARKS), "copies").withColumn("copy", F.lit(True))

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Sender(buckets, parts, smaller=False)
        for b in batches:
            ids, texts = b.column("doc_id").to_numpy(), b.column("text")
            for first, last in slices(texts):
                words, row = hashed_words(texts.slice(first, last - first))
                starts, least = anchors(words, row, window, seed)
                docs = ids[first + row[starts]]
                fresh = np.ones(len(docs), bool)
                fresh[1:] = (least[1:] != least[:-1]) | (docs[1:] != docs[:-1])
                out.add(docs[fresh], least[fresh], np.zeros(int(fresh.sum()), np.uint32), 6 * len(words))
                if out.size >= FLUSH:
                    yield from out.flush()
        yield from out.flush()

    def windows(left: pa.Table, right: pa.Table) -> pa.Table:
        out = Sender(buckets, parts, smaller=True)
        marked, copies, among = read_marks(right)
        for b in left.to_batches():
            ids, texts = b.column("doc_id").to_numpy(), b.column("text")
            for first, last in slices(texts):
                own, part = ids[first:last], texts.slice(first, last - first)
                words, row = hashed_words(part)
                starts, least = anchors(words, row, window, seed)
                hit = marked.hold(own[row[starts]], least)
                hit &= ~is_copy(own.tolist(), part, copies, among)[row[starts]]
                starts = starts[hit]
                check = run_hash(words, window, CHECK)[starts] >> np.uint64(32)
                out.add(own[row[starts]], run_hash(words, window, KEY)[starts], check.astype(np.uint32), 0)
        found = list(out.flush())
        return pa.Table.from_batches(found) if found else NOTHING

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        marked, copies, among = read_marks(right)
        kept, sizes, gone, spans = [], [], [], []
        for b in left.to_batches():
            texts, ids = b.column("text"), b.column("doc_id")
            known, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            for first, last in slices(texts):
                own, part = ids[first:last], texts.slice(first, last - first)
                words, row = hashed_words(part)
                starts = np.flatnonzero(row[:max(0, len(row) - window + 1)] == row[window - 1:])
                hit = marked.hold(own[row[starts]], run_hash(words, window, KEY)[starts]) & known[first:last][row[starts]]
                starts = starts[hit]
                copied = is_copy([x if ok else None for x, ok in zip(own.tolist(), known[first:last], strict=True)], part, copies, among)
                begin = np.searchsorted(row, np.arange(last - first + 1))
                at = np.searchsorted(starts, begin)
                for i in range(last - first):
                    n = int(begin[i + 1] - begin[i])
                    if copied[i]:
                        ranges = [(0, n)] if n >= window else []
                    else:
                        ranges = repeats(starts[at[i]:at[i + 1]] - begin[i], window)
                    tokens = (part[i].as_py() or "").encode().split()
                    if ranges:
                        stay = np.ones(n, bool)
                        for x, y in ranges:
                            stay[x:y] = False
                        tokens = compress(tokens, stay)
                    kept.append(b" ".join(tokens).decode())
                    sizes.append(n)
                    gone.append(sum(y - x for x, y in ranges))
                    spans.append([{"start": x, "end": y} for x, y in ranges])
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return left.drop_columns(["part"]).append_column("kept", pa.array(kept, pa.string())).append_column(
            "n_words", pa.array(sizes, pa.int64())).append_column(
            "n_removed", pa.array(gone, pa.int64())).append_column("repeats", pa.array(spans, span))

    sent = known.select("doc_id", "text").mapInArrow(seeds, PACKED)
    shared = stored(settle(sent, parts, smaller=False), "anchors").withColumn("copy", F.lit(False))
    dealt = docs.select(part_column(parts), "*")
    found = (
        dealt.where("doc_id is not null").select("part", "doc_id", "text").groupBy("part")
        .cogroup(shared.unionByName(copies).groupBy("part")).applyInArrow(windows, PACKED))
    last = stored(settle(found, parts, smaller=True), "repeats").withColumn("copy", F.lit(False))
    schema = StructType([*docs.schema.fields, *StructType.fromDDL(RESULT).fields])
    done = dealt.groupBy("part").cogroup(last.unionByName(copies).groupBy("part")).applyInArrow(finish, schema)
    back = {doc_id: c("doc_id").alias(doc_id), text: c("text").alias(text)}
    return done.select(
        *(back.get(x, c("rest").getField(x).alias(x) if x in extra else None) for x in df.columns if x in back or x in extra), *new)
