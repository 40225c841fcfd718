"""All queries of the subpackage and their SQL."""

from __future__ import annotations

from . import bpe, jaccard, lines, lm, media, mixing, negatives, packing, quality, spelling, substrings, topk, urls

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _m in (bpe, jaccard, lines, lm, media, mixing, negatives, packing, quality, spelling, substrings, topk, urls):
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
