"""Queries and SQL of this subpackage."""

from . import bpe, chat_format, html_extract, jaccard_join, language_id, media, merkle, mixing, quality_rules, spelling, toxicity, url_filter, word_bpe

_MODULES = (url_filter, mixing, jaccard_join, quality_rules, language_id, media, html_extract, chat_format, toxicity, bpe, merkle, word_bpe, spelling)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in _MODULES for k, s in m.ORACLE.items()}
