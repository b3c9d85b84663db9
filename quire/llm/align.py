"""Alignment of two tokenizers over the same texts.

Both encode the text; the ends of their tokens are summed up in bytes. Ends
kept in dictionaries from end to index are intersected as sets, the common ends
in order cut both id lists into groups, and each group links its tokens that
end together. How often a pair of ids is linked is counted over the corpus, and
each document is told how its links stand in these counts.

A text is taken in units: a space or line feed and what follows, up to the next
one that has no white space on either side. No token of either side reaches
across there (``Tables`` refuses a vocabulary in which one could), so a unit's
groups do not depend on its neighbours, and a worker keeps those of units it
has seen of late.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain, count
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.functions.frames import small
from quire.llm.store import stored
from quire.llm.words import slices

c = F.col
SPACE = "▁"
UNIT = re.compile(r"(?<=\S) (?=\S)")
MEMO = 250_000  # units a worker remembers of late, and as many from before
LONG = 64  # longer units are not remembered
STEP = 1 << 20  # characters of one text that are cut into units at once
RESULT = "n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, counts array<int>"
SHIFT = 32  # a pair is the id of A, shifted, and the id of B
NONE = (0, 0, 0, 0, "", b"")
COUNTS, GROUPS, PAIRS = itemgetter(0), itemgetter(1), itemgetter(2)
BITS = 40  # of each number in the counts of a unit: tokens of A, of B, groups, links
LOW = (1 << BITS) - 1


def letters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable bytes stand for themselves, the others for 256 and up, in order.
    """
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Tables:
    """Both tokenizers and the bytes of their tokens, as one worker holds them."""

    def __init__(self, tokenizer: bytes, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(tokenizer.decode())
        self.a.encode_special_tokens = True
        if json.loads(tokenizer)["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("the byte-level tokenizer must not add a space of its own")
        self.b = SentencePieceProcessor(model_proto=model)
        byte = letters()
        self.bytes_a = {i: bytes(map(byte.get, t)) if all(x in byte for x in t) else t.encode() for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece reaches across a space")
        spelled = [t.decode("utf-8", "replace").strip() for t in self.bytes_a.values()]
        if any(" " in t or "\n" in t for t in spelled):
            raise ValueError("a token reaches across a space or line feed")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.space = self.b.piece_to_id(SPACE)
        self.lines = not any("\n" in p for p in pieces)  # a line feed is a byte of its own, and nothing merges with it
        self.solid = all(self.bytes_a.values()) and all(self.bytes_b)  # every token has bytes
        self.name_a = {i: str(i) for i in self.bytes_a}
        self.name_b = [str(i) for i in range(len(pieces))]
        self.new: dict[str, tuple | None] = {}
        self.old: dict[str, tuple | None] = {}

    def units(self, texts: list[str], first: bool = False) -> list[tuple | None]:
        """The alignment of each unit; one that begins with a line feed stands for itself, unless it is the ``first`` of a text."""
        alone = [t[:1] == "\n" and not first for t in texts]
        whole = [t if x else " " + t for t, x in zip(texts, alone, strict=True)]
        b = self.b.encode(texts, num_threads=1)
        # the library puts a space before every text, which before a line feed is a token of its own
        b = [y[1:] if z and y[0] == self.space else y for y, z in zip(b, alone, strict=True)]
        data = [t.encode() for t in whole]
        odd = [i for i, t in enumerate(whole) if t[1:2].isspace() or t[-1:].isspace()] if self.solid else range(len(whole))
        if len(odd) < len(whole):
            apart = set(odd)
            plain = [i for i in range(len(whole)) if i not in apart]
            found = self.together([data[i] for i in plain], [b[i] for i in plain])
            if found:
                out: list[tuple | None] = [None] * len(whole)
                for i, x in zip(plain, found, strict=True):
                    out[i] = x
                for i, x in zip(odd, self.a.encode_batch_fast([whole[i] for i in odd], add_special_tokens=False), strict=True):
                    out[i] = self.match(data[i], x.ids, b[i])
                return out
        return [self.match(x, y.ids, z) for x, y, z in zip(data, self.a.encode_batch_fast(whole, add_special_tokens=False), b, strict=True)]

    def together(self, data: list[bytes], b: list[list[int]]) -> list[tuple] | None:
        """As ``match`` for many units at once, laid end to end as they may stand in a text; nothing if any of them is odd."""
        text = b"".join(data)
        flat_a = self.a.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids
        flat_b = list(chain.from_iterable(b))
        parts_a, parts_b = list(map(self.bytes_a.__getitem__, flat_a)), list(map(self.bytes_b.__getitem__, flat_b))
        if not b"".join(parts_a) == b"".join(parts_b) == text:
            return None
        index_a, index_b = ends(parts_a), ends(parts_b)
        common = sorted(index_a.keys() & index_b.keys())
        at = dict(zip(common, count(1), strict=False))
        name_a, name_b = self.name_a, self.name_b
        groups, pairs, i, j = [], [], 0, 0
        for end in common:
            next_a, next_b = index_a[end], index_b[end]
            left = name_a[flat_a[i]] if next_a - i == 1 else ",".join([name_a[x] for x in flat_a[i:next_a]])
            right = name_b[flat_b[j]] if next_b - j == 1 else ",".join([name_b[x] for x in flat_b[j:next_b]])
            groups.append(f"{left}|{right}")
            pairs.append(flat_a[next_a - 1] << SHIFT | flat_b[next_b - 1])
            i, j = next_a, next_b
        links = array("q", pairs).tobytes()
        out, first, first_a = [], 0, 0
        for end, y in zip(accumulate(map(len, data)), b, strict=True):
            last = at.get(end)
            if last is None:
                return None  # a unit that does not end where tokens of both sides end
            n, next_a = last - first, index_a[end]
            out.append((next_a - first_a | len(y) << BITS | n << 2 * BITS | n << 3 * BITS, ";".join(groups[first:last]), links[8 * first:8 * last]))
            first, first_a = last, next_a
        return out

    def match(self, data: bytes, a: list[int], b: list[int]) -> tuple | None:
        """The numbers of tokens, groups and links, the groups as text, and the linked pairs; nothing if the bytes differ."""
        parts_a, parts_b = [self.bytes_a[i] for i in a], [self.bytes_b[i] for i in b]
        if b"".join(parts_a) != data or b"".join(parts_b) != data:
            return None
        index_a, index_b = ends(parts_a), ends(parts_b)
        name_a, name_b = self.name_a, self.name_b
        groups, pairs, i, j = [], [], 0, 0
        for end in sorted(index_a.keys() & index_b.keys()):
            next_a, next_b = index_a[end], index_b[end]
            left = name_a[a[i]] if next_a - i == 1 else ",".join([name_a[x] for x in a[i:next_a]])
            right = name_b[b[j]] if next_b - j == 1 else ",".join([name_b[x] for x in b[j:next_b]])
            groups.append(f"{left}|{right}")
            if self.solid:
                pairs.append(a[next_a - 1] << SHIFT | b[next_b - 1])
            else:
                pairs += [x << SHIFT | y for x in last(a[i:next_a], self.bytes_a) for y in last(b[j:next_b], self.bytes_b)]
            i, j = next_a, next_b
        return len(a) | len(b) << BITS | len(groups) << 2 * BITS | len(pairs) << 3 * BITS, ";".join(groups), array("q", pairs).tobytes()

    def seen(self, lists: list[list[str]]) -> list[list[tuple | None]]:
        """As ``units`` for each list, with those that were met of late at hand."""
        new, old = self.new, self.old
        ask = []
        for t in set(chain.from_iterable(lists)).difference(new):
            if t in old:
                new[t] = old[t]
            else:
                ask.append(t)
        if ask:
            new.update(zip(ask, self.units(ask), strict=True))
        out = [list(map(new.__getitem__, x)) for x in lists]
        for t in ask:
            if len(t) > LONG:
                del new[t]
        if len(new) > MEMO:
            self.old, self.new = new, {}
        return out

    def cut(self, text: str) -> list[str]:
        """The units of a text, without the spaces in front of them."""
        parts = (text.replace("\n", " \n") if self.lines else text).split(" ")
        words = text.split()
        if len(words) == len(parts) and sum(map(len, words)) + len(words) - 1 == len(text):
            return parts  # no white space but single spaces and line feeds between words
        out = [parts[0]]
        for p in parts[1:]:
            line = p[:1] == "\n" and self.lines
            body = p[1:2] if line else p[:1]
            if body and not body.isspace() and out[-1] and not out[-1][-1].isspace():
                out.append(p)
            else:
                out[-1] += p if line else " " + p
        return out

    def align(self, texts: list[str | None]) -> list[tuple]:
        """Numbers of tokens of A and B, groups and links, the groups as text, and the linked pairs, for each text."""
        found: list[list[tuple | None]] = [[] for _ in texts]
        waiting: list[tuple[int, list[str]]] = []
        size = 0

        def settle() -> None:
            for (k, _), part in zip(waiting, self.seen([x for _, x in waiting]), strict=True):
                found[k] += part
            waiting.clear()

        for k, text in enumerate(texts):
            start = 0
            # the sign stands for a space in pieces, so the bytes of a text that holds it would differ
            while text and SPACE not in text and start < len(text):
                cut = UNIT.search(text, start + STEP) if start + STEP < len(text) else None
                stop = cut.start() if cut else len(text)
                part = self.cut(text[start:stop])
                if part[0][:1] == "\n":  # only at the start of a text
                    found[k] += self.units(part[:1], first=True)
                    part = part[1:]
                waiting.append((k, part))
                size += stop - start
                if size > STEP:
                    settle()
                    size = 0
                start = stop + 1
        settle()
        return [total(x) for x in found]


def total(whole: list[tuple | None]) -> tuple:
    """The alignment of a text from those of its units."""
    if not whole:
        return NONE
    try:
        n = sum(map(COUNTS, whole))
    except TypeError:  # a unit without alignment
        return NONE
    return n & LOW, n >> BITS & LOW, n >> 2 * BITS & LOW, n >> 3 * BITS, ";".join(map(GROUPS, whole)), b"".join(map(PAIRS, whole))


def ends(parts: list[bytes]) -> dict[int, int]:
    """For each end in bytes the number of tokens up to there; the last one counts, should tokens be empty."""
    return dict(zip(accumulate(map(len, parts)), count(1), strict=False))


def last(ids: list[int], spelled: dict[int, bytes] | list[bytes]) -> list[int]:
    """The tokens of a group that end where it ends: the last one, and the one before it as long as it is empty."""
    n = 1
    while not spelled[ids[-n]] and n < len(ids):
        n += 1
    return ids[-n:]


@lru_cache(maxsize=1)
def tables(tokenizer: bytes, model: bytes) -> Tables:
    return Tables(tokenizer, model)


def read(path: str) -> bytes:
    """A vocabulary file as the driver reads it; a few MB at most, sent along with the tasks."""
    with open(path, "rb") as f:
        return f.read()


def align(docs: DataFrame, tokenizer: bytes, model: bytes, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, with ``n_a, n_b, n_groups, n_links, groups, pairs, counts``.

    ``tokenizer`` is a byte-level file of the tokenizers library (A, which
    encodes a space and the text), ``model`` a SentencePiece file (B, which
    adds the space itself). ``groups`` has the ids of A and B between common
    ends, as in ``5,6|7;8|9,10``; ``pairs`` the distinct linked pairs of ids (A
    shifted by 32 bits, and B) and ``counts`` how often the text links them.

    A null or empty text, and one whose tokens do not spell a space and the
    text, have no tokens: zeros, an empty string and empty arrays. Strings of
    special tokens are plain text. Equal texts have equal results; a text of
    any length is taken in pieces of a million characters, where it has spaces.
    A column of ``docs`` named like a result gives way to it.
    """
    new = StructType.fromDDL(RESULT)
    extra = [x for x in docs.columns if x != text and x not in new.names]
    rows = docs.select(F.struct(*(c(f"`{x}`") for x in extra), F.lit(0).alias("_")).alias("doc"), c(f"`{text}`").alias("text"))
    schema = StructType([rows.schema["doc"], *new.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tables(tokenizer, model)
        for b in batches:
            for first, last in slices(b.column("text"), 1 << 18):
                part = b.slice(first, last - first)
                found = own.align(part.column("text").to_pylist())
                linked = [np.unique(np.frombuffer(x[5], np.int64), return_counts=True) for x in found]
                at = pa.array(np.concatenate([[0], np.cumsum([len(x) for x, _ in linked])]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    part.column("doc"), *(pa.array([x[k] for x in found], pa.int64()) for k in range(4)),
                    pa.array([x[4] for x in found], pa.string()),
                    pa.ListArray.from_arrays(at, pa.array(np.concatenate([x for x, _ in linked]))),
                    pa.ListArray.from_arrays(at, pa.array(np.concatenate([n for _, n in linked]).astype(np.int32))),
                ], names=["doc", *new.names])

    done = rows.mapInArrow(run, schema)
    return done.select(*(c("doc").getField(x).alias(x) for x in extra), *new.names)


def link_counts(aligned: DataFrame) -> DataFrame:
    """``pair, n, best`` of every linked pair of ids: its links in all documents, and whether its id of B has none with more."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select("x.pairs", c("x.counts").cast("long").alias("n"))
    counts = stored(each.groupBy(c("pairs").alias("pair")).agg(F.sum("n").alias("n")), "links")
    b = F.expr(f"pair & {(1 << SHIFT) - 1}L")
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return counts.withColumn("b", b).join(most, "b").select("pair", "n", (c("n") == c("most")).alias("best"))


def scored(aligned: DataFrame) -> DataFrame:
    """The columns of ``aligned`` without ``pairs`` and ``counts``, with ``n_best, count_sum``.

    ``count_sum`` adds up, over the links of a document, how many links of all
    documents hold the same pair; ``n_best`` are the links whose pair has as
    many as any pair of its id of B. The documents are stored once and told
    apart by row, so ids may be null or repeat.
    """
    kept = [x for x in aligned.columns if x not in ("pairs", "counts", "n_best", "count_sum")]
    rows = stored(aligned.select(F.monotonically_increasing_id().alias("_row"), F.struct(*kept).alias("doc"), "pairs", "counts"), "aligned")
    best = small(stored(link_counts(rows), "best"), rows=4_000_000)
    each = rows.select("_row", F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select("_row", c("x.pairs").alias("pair"), c("x.counts").alias("k"))
    sums = each.join(best, "pair").groupBy("_row").agg(
        F.sum(F.when(c("best"), c("k")).otherwise(0)).cast("long").alias("n_best"), F.sum(c("k") * c("n")).cast("long").alias("count_sum"))
    zero = lambda x: F.coalesce(c(x), F.lit(0).cast("long")).alias(x)
    return rows.select("_row", "doc").join(sums, "_row", "left").select("doc.*", zero("n_best"), zero("count_sum"))
