"""Guards of page flags must never lose a hit."""

from __future__ import annotations

import re

from ledgerloom import dims
from ledgerloom.operators import pages


def test_page_words_belong_to_their_patterns():
    for patterns, words in (
        (dims.PAGE_HEADERS, dims.PAGE_HEADER_WORDS), (dims.TABLE_INDICATORS, dims.TABLE_INDICATOR_WORDS),
        (dims.SUMMARY_PATTERNS, dims.SUMMARY_WORDS),
    ):
        assert len(patterns) == len(words)
        for pattern, ws in zip(patterns, words, strict=True):
            plain = re.sub(r"\\[bs][+*?]?", " ", pattern)
            assert all(w in plain for w in ws)


def test_page_flags_without_case(spark):
    rows = [(1, i + 1, t, "Polski") for i, t in enumerate(["Krzys faKtura nr 7/1", "SİGNATURE", "zaliczka", "plain", None])]
    out = pages.page_features(spark.createDataFrame(rows, "doc_id long, page_no int, text string, language string"))
    flags = [(r.has_header, r.has_signature) for r in out.orderBy("page_no").collect()]
    assert flags == [(True, False), (False, True), (True, False), (False, False), (False, False)]
