"""The queries of all training-data operators, and their SQL."""

from __future__ import annotations

from . import best_fit_packing, chat_format, conversation_repair, decontamination, exact_search, fill_in_middle, group_packing, licence_scan, lm_scoring, quality_resampling, simhash_dedup, token_counts, warc

MODULES = (chat_format, exact_search, warc, quality_resampling, decontamination, best_fit_packing, lm_scoring, licence_scan, simhash_dedup, token_counts, fill_in_middle, group_packing, conversation_repair)

QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
