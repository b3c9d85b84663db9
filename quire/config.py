"""Tunable defaults of the pipeline."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Every threshold the operators use.

    The numbers are fixed values: results only match when these defaults hold.
    """

    banner_patterns: tuple[str, ...] = (r"Downloaded from https://onlinelibrary\.wiley\.com",)

    # chunk ids: every document owns one block of this many ids
    id_stride: int = 1 << 20

    # chunk packing, in tokens
    target_tokens: int = 450
    max_tokens: int = 800
    min_tokens: int = 40
    overlap_tokens: int = 80

    # headings
    max_chapter: int = 20

    # issue splitting
    min_issue_pages: int = 80
    min_article_bookmarks: int = 6
    min_article_pages: int = 2
    shouty_ratio: float = 0.6

    # printed-page vote
    offset_sample: int = 8
    offset_low: int = -400
    offset_high: int = 30000
    offset_quorum: int = 3

    # titles and folios on a page
    min_title: int = 12
    max_title: int = 300
    folio_head: int = 4
    folio_foot: int = 3
    folio_most: int = 30000

    # pages with fewer characters on average have no text layer
    ocr_threshold: int = 120

    # retrieval
    k: int = 5
    candidates: int = 30
    tool_k: int = 6
    tool_k_max: int = 15
    rrf_constant: int = 60
    dense_dim: int = 64
    context_reach: int = 3
    catalog_cap: int = 80
    history_messages: int = 6

    # queries scored at once against a batch of points, and queries shipped to every task at once
    query_block: int = 512
    query_pass: int = 20_000
    preview_characters: int = 600

    # broadcast sides are checked against this row count
    broadcast_rows: int = 200_000
    broadcast_bytes: int = 64 << 20



DEFAULTS = Settings()
