"""Small hand-made cases with known results."""

import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import chunking as K
from quire.operators import cleaning as C
from quire.operators import pages as P
from quire.operators import registry as G
from quire.operators import retrieval as R
from quire.operators import sections as S

c = F.col


def one(spark, expr, **columns):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in columns.items()))
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("name, key", [
    ("Analysis of Multiconductor Transmission Lines 2e", "multiconductor_transmiss"),
    ("The IEEE Press 2024", "the_ieee_pre"),
    ("!!!", "doc"),
    ("Digital_Signal Integrity (Wiley)", "digital_signal"),
])
def test_short_key(spark, name, key):
    assert one(spark, T.short_key(c("t")), t=name) == key


def test_normalize(spark):
    text = "ﬁne “quote” co‑op soft­hyphen x  y – dash ²"
    assert one(spark, T.normalize(c("t")), t=text) == "fine \"quote\" co-op softhyphen x  y - dash 2"


def test_strip_knows_unicode_space(spark):
    assert one(spark, T.strip(c("t")), t=" 　\t a b \r\n") == "a b"


@pytest.mark.parametrize("text, n", [("", 1), ("one", 2), ("a b  c\n d", 6), (" x y ", 3)])
def test_token_count(spark, text, n):
    assert one(spark, T.token_count(c("t")), t=text) == n


def test_shouty(spark):
    assert one(spark, T.is_shouty(c("t")), t="INKED PECIAL SSUES") is True
    assert one(spark, T.is_shouty(c("t")), t="A study of GPU Coupling in Lines") is False
    assert one(spark, T.is_shouty(c("t")), t="of a") is True


def test_lift_captions(spark):
    lines = [
        "[PAGE 1]", "intro text that", "FIGURE 3.3 Cross section", "second caption line", "",
        "length resistance matrix", "[PAGE 2]", "Table 1 first line stays", "after",
    ]
    assert one(spark, P.join_pages(C.lift_captions(P.page_array(c("t")))), t="\n".join(lines)).split("\n") == [
        "[PAGE 1]", "intro text that", "", "length resistance matrix", "", "FIGURE 3.3 Cross section",
        "second caption line", "", "[PAGE 2]", "Table 1 first line stays", "after",
    ]
    assert one(spark, C.count_captions(P.page_array(c("t"))), t="\n".join(lines)) == 1


def test_long_caption_block_uses_no_stack(spark):
    text = "x\nFigure 1 a\n" + "\n".join(["line of the block"] * 20000)
    out = one(spark, P.join_pages(C.lift_captions(P.page_array(c("t")))), t=text)
    assert out.startswith("x\n\nFigure 1 a\n") and out.count("line of the block") == 20000


def test_fix_hyphenation(spark):
    lines = [
        "uses high-speed links", "the propaga-", "tion of high-", "speed waves per-", "", "[PAGE 2]",
        "unit length", "A-", "B",
    ]
    got = one(spark, C.fix_hyphenation(c("t"), C.hyphen_lexicon(c("t"))), t="\n".join(lines))
    assert got["text"].split("\n") == [
        "uses high-speed links", "the propagation of high-", "speed waves perunit length", "[PAGE 2]", "A-", "B",
    ]
    assert got["joined"] == 2


def test_hyphen_kept_where_the_document_writes_it(spark):
    text = "a high-speed link and a High-\n\n\nspeed one"
    got = one(spark, C.fix_hyphenation(c("t"), C.hyphen_lexicon(c("t"))), t=text)
    assert got["text"] == "a high-speed link and a High-speed one"
    # one blank line too many
    far = text.replace("\n\n\n", "\n\n\n\n\n")
    assert one(spark, C.fix_hyphenation(c("t"), C.hyphen_lexicon(c("t"))), t=far)["joined"] == 0


def test_reflow(spark):
    lines = [
        "the inductance matrix of the line is found from the",
        "(transposed) capacitance matrix of the line when", "",
        "the medium is homogeneous around all the conductors.",
        "Next paragraph starts here with a capital letter ok",
    ]
    assert one(spark, C.reflow(F.split(c("t"), "\n")), t="\n".join(lines)).split("\n") == [
        " ".join([lines[0], lines[1], lines[3]]), lines[4],
    ]


def numbered(pages):
    return "\n".join(f"[PAGE {n}]\n{body}" for n, body in pages)


CONTENTS = "\n".join(["Contents"] + [f"Some chapter title {i}" for i in range(8)])
PROSE = "\n".join(["a very long line of running prose " * 4] * 4)
INDEX = "\n".join(f"entry{i}, {i}, {i + 3}" for i in range(9))


def test_front_matter(spark):
    kinds = {2: CONTENTS, 5: CONTENTS, 8: PROSE}
    text = numbered([(n, kinds.get(n, "short")) for n in range(1, 61)])
    got = one(spark, P.front_matter(P.split_pages(c("t"))), t=text)
    assert [(r["lo"], r["hi"]) for r in got] == [(2, 7)]
    assert one(spark, P.front_matter(P.split_pages(c("t"))), t=numbered([(1, "x"), (2, "y")])) == []


def test_back_matter(spark):
    hits = {92, 93, 96, 98}
    text = numbered([(n, INDEX if n in hits else "short") for n in range(1, 101)])
    assert one(spark, P.back_matter(P.split_pages(c("t"))), t=text) == 92
    lone = numbered([(n, INDEX if n in {97, 98} else "short") for n in range(1, 101)])
    assert one(spark, P.back_matter(P.split_pages(c("t"))), t=lone) is None


def test_pack(spark):
    def block(word, n, lo, hi):
        return (" ".join([word] * n), lo, hi)

    blocks = [
        block("a", 200, 1, 1), block("b", 40, 1, 2), block("c", 150, 2, 2), block("d", 10, None, None),
        (" ".join([" ".join(["e"] * 99) + " e."] * 7), 3, 4), block("f", 20, 5, 5),
    ]
    df = spark.createDataFrame(
        [(blocks, "[T | S | Section 1.1 X]")],
        "blocks array<struct<text string,page_start int,page_end int>>, header string",
    )
    rows = df.select(F.explode(K.pack(c("blocks"), c("header"))).alias("k")).select("k.*").collect()
    assert [(len(r["text"].split()), r["page_start"], r["page_end"], r["n_tokens"]) for r in rows] == [
        (240, 1, 2, 335), (200, 1, 2, 281), (300, 3, 4, 416), (300, 3, 4, 416), (100, 3, 4, 146), (20, 5, 5, 38),
    ]


def sections_of(spark, text, kind):
    got = one(spark, S.parse_sections(c("t"), c("k")), t=text, k=kind)
    return [
        (s["chapter"], s["section"], s["title"], [(b["text"], b["page_start"], b["page_end"]) for b in s["blocks"]])
        for s in got
    ]


def test_book_sections(spark):
    text = (
        "# comment\nopening\n[PAGE 3]\n1.2 The Problem Stated\nfirst\nsecond\n[PAGE 4]\nthird\n\n"
        "last\n3.4 Listing 12\n21.1 Too Far Away\n"
    )
    assert sections_of(spark, text, "book") == [
        (None, None, "front matter", [("opening", None, 3)]),
        (1, "1.2", "The Problem Stated", [
            ("first\nsecond\nthird", 3, 4), ("last\n3.4 Listing 12\n21.1 Too Far Away", 4, 4),
        ]),
    ]


def test_paper_sections(spark):
    text = (
        "[PAGE 7]\nabstract text\nA. Smith is with nobody\nII. ANTENNA DESIGN\nbody\nA. Feed Network\nfeed\n"
        "[PAGE 8]\nIV. Results 12\nV. RESULTS\nnumbers"
    )
    assert sections_of(spark, text, "article") == [
        (None, None, "abstract", [("abstract text\nA. Smith is with nobody", 7, 7)]),
        (2, "II", "ANTENNA DESIGN", [("body", 7, 7)]),
        (2, "II.A", "Feed Network", [("feed\nIV. Results 12", 7, 8)]),
        (5, "V", "RESULTS", [("numbers", 8, 8)]),
    ]


@pytest.mark.parametrize("section, lo, hi, source, line", [
    ("3.4", 5, 5, "", "Book | S3.4 Lines | p.5"),
    (None, 5, 6, "J / 2024", "Book | J / 2024 | Lines | pp.5-6"),
    (None, None, None, "", "Book | Lines | p.None"),
    (None, None, 6, "", "Book | Lines | pp.None-6"),
])
def test_cite(spark, section, lo, hi, source, line):
    df = spark.createDataFrame(
        [("Book", source, section, "Lines", lo, hi)],
        "book_title string, source string, section string, section_title string, page_start int, page_end int",
    )
    assert df.select(R.cite_row()).first()[0] == line


def test_folio_candidates(spark):
    text = "\n".join(["Vol. 12, No. 3", "", "a 417", "b", "c", "d 99999 400000", "e", "f 0 20"])
    assert sorted(one(spark, G.folio_candidates(c("t")), t=text)) == [3, 12, 20, 417]


def test_written_clean_text_is_read_back_the_same(spark):
    raw = "# SOURCE: a.pdf\n# TITLE: T\n# PAGES: pdf index\n# EXTRACTION: x\n\n[PAGE 1]\nbody\n"
    written = one(spark, C.render_clean(c("r"), c("t")), r=raw, t=raw)
    assert written.startswith("# SOURCE: a.pdf\n# TITLE: T\n# PAGES: pdf index\n# CLEANED: matter trimmed")
    assert sections_of(spark, written, "book") == sections_of(spark, raw, "book") == [
        (None, None, "front matter", [("body", 1, 1)])
    ]


def test_preview(spark):
    assert one(spark, R.preview(c("t")), t="a\nb" + "x" * 700) == "a b" + "x" * 597 + " ..."


def test_bound_values_are_evaluated_once(spark):
    """A per-element lookup must not rebuild the array it looks into."""
    import time

    from quire.functions.expr import bind

    text = "\n".join(["line"] * 20000)
    start = time.time()
    n = one(spark, bind(F.split(c("t"), "\n"), lambda ls: F.size(F.filter(ls, lambda l, i: F.get(ls, i - 1) == l))), t=text)
    assert n == 19999 and time.time() - start < 20
