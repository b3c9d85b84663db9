"""Row types of the tables the stages exchange."""

RANGE = "struct<lo:int,hi:int>"

REGISTRY = (
    f"key string, pdf string, title string, kind string, source string, slot bigint, pages {RANGE}, "
    f"page_offset int, skip_pages array<{RANGE}>, body_end_page int, auto array<string>, text string, pdf_hash string, "
    "text_hash string, clean_sig string, chunk_sig string, chunks bigint"
)
CHUNKS = (
    "id bigint, book string, book_title string, kind string, source string, chapter int, section string, "
    "section_title string, page_start int, page_end int, n_tokens int, text string, embed_text string"
)
POINTS = CHUNKS.replace(", embed_text string", "") + ", dense array<float>, terms array<bigint>, weights array<float>"
MANIFEST = "slot bigint, key string, title string, sig string, chunks bigint, kind string, source string, input_sig string"
PAGES = "pdf string, page int, text string"
QUERIES = "qid bigint, text string"
