"""Alignment of tokenizers against whole-text encodings and plain counting."""

import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from quire.llm import align as A
from quire.llm.queries import BYTE_TOKENIZER, TOKENIZER

ODD = [None, "", " ", "   a", "a   b ", "a\n b\n\n c", "x  y", "▁ sign", "a▁b", "<|endoftext|> and <s> <0x0A>", "é東x😀 fi", "it's 12,345 'll", "a" * 3000, "\x00 \x1c a", "\nfirst line\nsecond\n\nthird \n fourth\n", "one\ntwo", "\n", "a\r\nb", "don't 　 wide"]


@pytest.fixture(scope="module")
def texts(spark, sf):
    r = random.Random(5)
    found = [x["text"] for x in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    return found + ODD + ["".join(r.choice("ab   \n\tthé'▁ing東x😀0_., ") for _ in range(r.randint(0, 60))) for _ in range(400)]


def brute(texts):
    a = Tokenizer.from_file(BYTE_TOKENIZER)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)
    byte = A.letters()
    name = {i: t for t, i in a.get_vocab().items()}
    out, counts = [], Counter()
    for t in texts:
        x = a.encode(" " + (t or ""), add_special_tokens=False).ids if t else []
        y = b.encode(t) if t else []
        bytes_x = [bytes(byte[ch] for ch in name[i]) for i in x]
        bytes_y = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in y)]
        if not t or not b"".join(bytes_x) == b"".join(bytes_y) == (" " + t).encode():
            out.append((0, 0, 0, 0, "", []))
            continue
        groups, links, i, j, end_x, end_y = [], [], 0, 0, 0, 0
        for k, p in enumerate(bytes_x):
            end_x += len(p)
            while end_y < end_x:
                end_y += len(bytes_y[j])
                j += 1
            if end_x == end_y:
                first = sum(len(g[1]) for g in groups)
                groups.append((x[i:k + 1], y[first:j]))
                links.append((x[k], y[j - 1]))
                i = k + 1
        counts.update(links)
        show = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((len(x), len(y), len(groups), len(links), show, links))
    best = {}
    for (_, q), n in counts.items():
        best[q] = max(best.get(q, 0), n)
    return [(*r[:5], sum(counts[p] == best[p[1]] for p in r[5]), sum(counts[p] for p in r[5])) for r in out]


def aligned(spark, texts):
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(texts)], "doc_id long, text string, groups string, _row int").repartition(4)
    return A.align(df, A.read(BYTE_TOKENIZER), A.read(TOKENIZER))


def test_against_whole_encodings(spark, texts):
    out = A.scored(aligned(spark, texts))
    assert out.columns == ["doc_id", "_row", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
    rows = sorted(out.collect(), key=lambda r: r["doc_id"])
    got = [tuple(r[x] for x in ("n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum")) for r in rows]
    for t, x, y in zip(texts, got, brute(texts), strict=True):
        assert x == y, t


def test_counts_by_a_shuffle(spark, texts, monkeypatch):
    monkeypatch.setattr(A, "small", lambda df, *a, **b: df)
    some = texts[:80]
    got = {r["doc_id"]: (r["n_best"], r["count_sum"]) for r in A.scored(aligned(spark, some)).collect()}
    assert got == {i: x[5:] for i, x in enumerate(brute(some))}


def test_long_texts_are_taken_in_pieces(spark, texts, monkeypatch):
    monkeypatch.setattr(A, "STEP", 7)
    monkeypatch.setattr(A, "MEMO", 3)
    monkeypatch.setattr(A, "LONG", 5)
    own = A.Tables(A.read(BYTE_TOKENIZER), A.read(TOKENIZER))
    want = brute(texts[:40] + ODD)
    assert [x[:5] for x in own.align(texts[:40] + ODD)] == [x[:5] for x in want]
    assert [own.align([t])[0][:5] for t in texts[:40] + ODD] == [x[:5] for x in want]


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "same"), (None, "same"), (1, None)], "doc_id long, text string")
    out = A.scored(A.align(df, A.read(BYTE_TOKENIZER), A.read(TOKENIZER)))
    assert sorted((r["doc_id"] or 0, r["n_links"], r["count_sum"]) for r in out.collect()) == [(0, 1, 2), (0, 1, 2), (1, 0, 0)]
    assert A.scored(A.align(df.limit(0), A.read(BYTE_TOKENIZER), A.read(TOKENIZER))).count() == 0


def test_tokens_without_bytes_share_an_end():
    assert A.ends([b"a", b"", b"bc"]) == {1: 2, 3: 3}
    assert A.last([7, 8, 9], {7: b"x", 8: b"y", 9: b""}) == [8, 9]
    assert A.last([9], {9: b""}) == [9]


def test_query(spark, sf):
    from quire.llm.queries import QUERIES

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {
        r["doc_id"]: (*x[:4], *x[5:], hashlib.sha256(x[4].encode()).hexdigest() if x[2] else "")
        for r, x in zip(docs, brute([r["text"] for r in docs]), strict=True)}
    got = QUERIES["op11_cross_tokenizer"](spark, sf)
    assert {r["doc_id"]: tuple(r[x] for x in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in got.collect()} == want
