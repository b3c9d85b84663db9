"""SentencePiece encoding and decoding on an Aho-Corasick automaton."""

from __future__ import annotations

import re
import struct
from array import array
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.llm.words import slices

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)  # kinds of pieces, fixed by the file format
UNIGRAM, BPE = 1, 2  # kinds of models, fixed by the file format
RESULT = "token_ids array<int>, n_tokens long, decoded string"
MEMO = 120_000  # segmentations a worker remembers of late, and as many from before
HEAD, HEADS = 6, 50_000  # length and number of beginnings it remembers
PAIRS = 1_000_000  # judgements on pairs of tokens it remembers
START = -2  # stands for the token before the first
SHORT = 64  # longer stretches of text are not remembered
STEP = 1 << 20  # characters of one text that are split at once


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        number, kind = tag >> 3, tag & 7
        if kind == 0:
            yield number, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield number, data[at:at + size]
            at += size


class Model:
    """A model file: pieces with scores and kinds, and the settings that matter here.

    A model with a normalisation table, with user-defined or with unused pieces
    is refused: its text rules are not implemented.
    """

    def __init__(self, data: bytes) -> None:
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        trainer: dict = {}
        normal: dict = {}
        for number, value in fields(data):
            if number == 1:
                one = dict(fields(value))
                self.pieces.append(one.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", one[2])[0] if 2 in one else 0.0)
                self.kinds.append(one.get(3, NORMAL))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normal = dict(fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.fallback = bool(trainer.get(35, 0))
        self.prefix = bool(normal.get(3, 1))
        if self.kind not in (UNIGRAM, BPE) or normal.get(2) or normal.get(4, 1) or {USER, UNUSED} & set(self.kinds):
            raise ValueError("a kind of model or text rule that is not implemented")
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        if self.fallback and len(self.bytes) != 256:
            raise ValueError("byte fallback without all byte pieces")
        self.out = [
            b"" if k == CONTROL else bytes([int(p[3:5], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN
            else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, self.kinds, strict=True)
        ]


class Automaton:
    """Aho-Corasick automaton over the pieces.

    ``ends[n]`` is the piece that ends at node ``n`` (-1: none), ``link[n]`` the
    nearest shorter suffix that is a piece: the output link.
    """

    def __init__(self, ids: dict[str, int]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.ends = [-1]
        for piece, i in ids.items():
            node = 0
            for ch in piece:
                if ch not in self.next[node]:
                    self.next[node][ch] = len(self.next)
                    self.next.append({})
                    self.ends.append(-1)
                node = self.next[node][ch]
            self.ends[node] = i
        self.fail = [0] * len(self.next)
        self.link = [0] * len(self.next)
        self.letters = {ch for piece in ids for ch in piece}
        queue = deque(self.next[0].values())
        while queue:
            node = queue.popleft()
            for ch, child in self.next[node].items():
                back = self.step(self.fail[node], ch)
                self.fail[child] = back
                self.link[child] = back if self.ends[back] >= 0 else self.link[back]
                queue.append(child)

    def step(self, node: int, ch: str) -> int:
        """Where a character leads, along the failure links."""
        while node and ch not in self.next[node]:
            node = self.fail[node]
        return self.next[node].get(ch, 0)

    def outputs(self, node: int) -> list[int]:
        """The pieces that end at a node, longest first, along the output links."""
        found, at = [], node if self.ends[node] >= 0 else self.link[node]
        while at:
            found.append(self.ends[at])
            at = self.link[at]
        return found


class Encoder(dict):
    """Segments texts; as a dict it remembers the ids of short stretches of text."""

    def __init__(self, data: bytes) -> None:
        super().__init__()
        self.before: dict[str, bytes] = {}
        self.heads: dict[str, tuple[int, list[int], list[float]]] = {}
        self.model = m = Model(data)
        self.automaton = walk = Automaton(m.ids)
        # steps taken before, by node and character; a node's outputs with length and known judgements
        self.steps: list[dict[str, int]] = [dict(x) for x in walk.next]
        self.outputs: list[tuple | None] = [None] * len(walk.next)
        self.judged: dict[int, dict[int, bool]] = {t: {} for t in m.ids.values()}
        self.n_judged = 0
        self.penalty = min((m.scores[i] for i in m.ids.values()), default=0.0) - 10.0
        # a stretch ends where no piece reaches across: in front of spaces if no
        # piece has one inside, and around characters that no piece has
        inside = any(SPACE in p.lstrip(SPACE) for p in m.ids)
        letters = {ch for p in m.ids for ch in p}
        alone = "".join(ch for ch in "\t\n\r" if ch not in letters)
        word = f"{SPACE}*[^{SPACE}{re.escape(alone)}]+|{SPACE}+" if not inside else f"[^{re.escape(alone)}]+"
        self.split = re.compile(f"[{re.escape(alone)}]|{word}" if alone else word).findall
        self.border = re.compile(f"(?<!{SPACE}){SPACE}" if not inside else f"[{re.escape(alone)}]" if alone else "(?!)").search

    def __missing__(self, stretch: str) -> bytes:
        ids = self.before.get(stretch)
        if ids is None:
            ids = array("i", self.spell(stretch, self.segment(stretch))).tobytes()
        if len(stretch) <= SHORT:
            if len(self) >= MEMO:
                self.before = dict(self)
                self.clear()
            self[stretch] = ids
        return ids

    def ends_at(self, node: int) -> tuple:
        """Pieces that end at a node, longest first, with their length and what is known about them."""
        pieces, scores = self.model.pieces, self.model.scores
        known = self.outputs[node] = tuple(
            (t, len(pieces[t]), self.judged[t], scores[t]) for t in self.automaton.outputs(node))
        return known

    def step(self, node: int, ch: str) -> int:
        to = self.automaton.step(node, ch)
        if ch in self.automaton.letters:  # bounded by nodes and letters of the model
            self.steps[node][ch] = to
        return to

    def segment(self, text: str) -> list[int]:
        """Tokens of a stretch in one pass over the automaton: ids, or -1 for a character that is no piece."""
        steps, outputs, bpe = self.steps, self.outputs, self.model.kind == BPE
        head = text[:HEAD]  # stretches with the same beginning share the first steps
        if head in self.heads:
            node, best, score = self.heads[head]
            best, score, first = best[:], score[:], HEAD
        else:  # of each prefix: its last token, and its score
            node, best, score, first = 0, [START], [0.0], 0
        for i, ch in enumerate(text[first:], first + 1):
            to = steps[node].get(ch)
            node = self.step(node, ch) if to is None else to
            found = outputs[node]
            if found is None:
                found = self.ends_at(node)
            pick = -1
            if bpe:
                for t, n, judged, _ in found:
                    fits = judged.get(best[i - n])
                    if fits is None:
                        fits = self.fits(best[i - n], t)
                    if fits:
                        pick = t
                        break
            else:
                top, single = -1e300, False
                for t, n, _, value in found:
                    single = single or n == 1
                    if score[i - n] + value > top:
                        pick, top = t, score[i - n] + value
                if not single and score[i - 1] + self.penalty > top:
                    pick, top = -1, score[i - 1] + self.penalty
                score.append(top)
            best.append(pick)
            if i == HEAD and not first:
                if len(self.heads) >= HEADS:
                    self.heads.clear()
                self.heads[head] = node, best[:], score[:]
        tokens, end, pieces = [], len(text), self.model.pieces
        while end:
            t = best[end]
            tokens.append(t)
            end -= len(pieces[t]) if t >= 0 else 1
        return tokens[::-1]

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the text of two tokens gives just these two again.

        Behind an unknown character or at the start the second one has to stand alone.
        """
        self.n_judged += 1
        if self.n_judged > PAIRS:
            for x in self.judged.values():
                x.clear()
            self.n_judged = 0
        pieces = self.model.pieces
        first = [pieces[left]] if left >= 0 else []
        known = self.judged[right][left] = self.merge("".join(first) + pieces[right]) == [*first, pieces[right]]
        return known

    def merge(self, text: str) -> list[str]:
        """The byte-pair rule itself, for short texts: join the best-scored neighbours, leftmost first."""
        parts, ids, scores = list(text), self.model.ids, self.model.scores
        while len(parts) > 1:
            top, at = None, -1
            for i in range(len(parts) - 1):
                t = ids.get(parts[i] + parts[i + 1])
                if t is not None and (top is None or scores[t] > top):
                    top, at = scores[t], i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def spell(self, text: str, tokens: list[int]) -> list[int]:
        """Ids of tokens; what is no piece is spelled in bytes or is unknown."""
        if -1 not in tokens:
            return tokens
        ids: list[int] = []
        at = 0
        for t in tokens:
            if t >= 0:
                ids.append(t)
                at += len(self.model.pieces[t])
            else:
                ids += [self.model.bytes[b] for b in text[at].encode()] if self.model.fallback else [self.model.unknown]
                at += 1
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a text as int32 bytes."""
        if not text:
            return b""
        text = (SPACE if self.model.prefix else "") + text.replace(" ", SPACE)
        out, start = [], 0
        while start < len(text):
            cut = self.border(text, start + STEP)
            end = cut.start() if cut else len(text)
            out.append(b"".join(map(self.__getitem__, self.split(text[start:end]))))
            start = end
        ids = b"".join(out)
        if not self.model.fallback:  # neighbouring unknown characters are one token
            x = np.frombuffer(ids, np.int32)
            twice = (x[1:] == self.model.unknown) & (x[:-1] == self.model.unknown)
            ids = x[np.concatenate([[True], ~twice])].tobytes()
        return ids

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.model.out.__getitem__, ids)).decode("utf-8", "replace")
        return text.removeprefix(" ") if self.model.prefix else text


@lru_cache(maxsize=2)
def encoder(data: bytes) -> Encoder:
    return Encoder(data)


def read_model(path: str) -> bytes:
    """The model file as the driver reads it; a few hundred kB, sent along with the tasks."""
    with open(path, "rb") as f:
        return f.read()


def _sized(lists: list[bytes]) -> pa.Array:
    ids = np.frombuffer(b"".join(lists), np.int32)
    ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in lists])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))


def encode(df: DataFrame, model: bytes, text: str = "text", decode: bool = False) -> DataFrame:
    """The columns of ``df`` with ``token_ids, n_tokens`` and, with ``decode``, ``decoded``.

    One pass of the automaton gives the pieces that end at each position, longest
    first, by its output links. For a unigram model the best score of each
    position is relaxed over them (Viterbi). For a byte-pair model scores do not
    add up, so the relaxation is another one: of the pieces that end at a
    position the one that merging leaves next to the last token of the prefix
    before it; there is exactly one. Ids are those of the SentencePiece library.

    A null text gives null ids, count and text, an empty text no ids. Text of
    any length is split where no piece reaches across. Columns of ``df`` named
    like a result are replaced.
    """
    new = ["token_ids", "n_tokens", *(["decoded"] if decode else [])]
    extra = [x for x in df.columns if x not in (text, *new)]
    df = df.select(*(F.col(f"`{x}`") for x in extra), F.col(text).alias(text))
    schema = StructType([*df.schema.fields, *StructType.fromDDL(RESULT).fields[:len(new)]])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value)
        for b in batches:
            for first, last in slices(b.column(text), 1 << 20):
                part = b.slice(first, last - first)
                texts = part.column(text)
                lists = [own.encode(x or "") for x in texts.to_pylist()]
                none = texts.is_null()
                sizes = pa.compute.if_else(none, None, pa.array([len(x) // 4 for x in lists], pa.int64()))
                ids = _sized(lists)
                if none.true_count:
                    ids = pa.compute.if_else(none, None, ids)
                out = [ids, sizes]
                if decode:
                    back = [own.decode(np.frombuffer(x, np.int32).tolist()) for x in lists]
                    out.append(pa.compute.if_else(none, None, pa.array(back, pa.string())))
                yield pa.RecordBatch.from_arrays([*part.columns, *out], [*extra, text, *new])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, model: bytes, token_ids: str = "token_ids") -> DataFrame:
    """The columns of ``df`` with ``decoded``; null ids give a null text, null elements are skipped."""
    extra = [x for x in df.columns if x != "decoded"]
    df = df.select(*(F.col(f"`{x}`") for x in extra))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value)
        for b in batches:
            back = [None if x is None else own.decode([i for i in x if i is not None]) for x in b.column(token_ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(back, pa.string())], [*extra, "decoded"])

    return df.mapInArrow(run, StructType([*df.schema.fields, *StructType.fromDDL("decoded string").fields]))
