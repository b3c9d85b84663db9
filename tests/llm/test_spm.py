"""Ids against the SentencePiece library, and round trips."""

import random

import numpy as np
import pytest
import sentencepiece

from quire.llm import spm
from quire.llm.queries import TOKENIZER

ODD = ["", " ", "   a", "a   ", "\n", "\r\n\t", "a" * 3000, "▁", "é東x😀", "The quick brown fox's 12,345 dogs.", "<s> <0x0A> <unk>"]


def _varint(x):
    out = bytearray()
    while True:
        out.append(x & 127 | (128 if x > 127 else 0))
        x >>= 7
        if not x:
            return bytes(out)


def _field(number, value):
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


@pytest.fixture(scope="module")
def texts(spark, sf):
    r = random.Random(1)
    found = [x["text"] for x in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    return found + ODD + ["".join(r.choice("ab  \n\tthé▁ing東x😀0_") for _ in range(r.randint(0, 60))) for _ in range(1500)]


def ids(own, text):
    return np.frombuffer(own.encode(text), np.int32).tolist()


def test_ids_of_the_byte_pair_model(texts):
    data = spm.read_model(TOKENIZER)
    own, theirs = spm.encoder(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    assert own.model.kind == spm.BPE
    for t, want in zip(texts, theirs.encode(texts), strict=True):
        assert ids(own, t) == want
        assert own.decode(want) == theirs.decode(want) == t.replace("▁", " ")


def test_viterbi_of_a_unigram_model(texts):
    """Two orders of the same pieces tie, so the best total is compared, not the path."""
    piece = lambda text, score: _field(1, _field(1, text.encode()) + b"\x15" + np.float32(score).tobytes())
    r = random.Random(4)
    pieces = sorted({"".join(r.choice("abé▁") for _ in range(r.randint(2, 4))) for _ in range(60)} | set("abé▁"))
    unknown = _field(1, _field(1, b"<unk>") + b"\x15" + np.float32(0).tobytes() + _field(3, spm.UNKNOWN))
    normal = _field(1, b"identity") + _field(3, 1) + _field(4, 0)
    data = unknown + b"".join(piece(p, -r.uniform(1, 9)) for p in pieces) + _field(2, _field(3, spm.UNIGRAM) + _field(40, 0)) + _field(3, normal)
    own, theirs = spm.Encoder(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    for _ in range(2000):
        t = "".join(r.choice("abé zq") for _ in range(r.randint(0, 25)))
        mine, want = ids(own, t), theirs.encode(t)
        total = lambda xs: sum(own.model.scores[i] if i else own.penalty for i in xs)
        assert abs(total(mine) - total(want)) < 1e-3 and own.decode(mine) == theirs.decode(want), t


def test_long_texts_are_cut_where_no_piece_reaches(monkeypatch):
    data = spm.read_model(TOKENIZER)
    own = spm.encoder(data)
    text = "some words  and\nlines " * 300
    whole = ids(own, text)
    monkeypatch.setattr(spm, "STEP", 7)
    assert ids(own, text) == whole


def test_frames(spark):
    data = spm.read_model(TOKENIZER)
    rows = [(1, "a cat", 5, "x"), (1, "a cat", 5, "x"), (None, None, None, None), (2, "", 1, "y"), (3, "東 é\n" * 2000, 0, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, decoded string")
    out = spm.encode(df, data, decode=True)
    assert out.columns == ["doc_id", "text", "token_ids", "n_tokens", "decoded"]
    theirs = sentencepiece.SentencePieceProcessor(model_proto=data)
    for r in out.collect():
        if r["text"] is None:
            assert r["token_ids"] is None and r["n_tokens"] is None and r["decoded"] is None
        else:
            assert r["token_ids"] == theirs.encode(r["text"]) and r["n_tokens"] == len(r["token_ids"])
            assert r["decoded"] == r["text"]
    back = spm.decode(out.drop("decoded"), data).collect()
    assert [r["decoded"] for r in back] == [r["text"] for r in back]
    assert spm.encode(df.limit(0), data).count() == 0
