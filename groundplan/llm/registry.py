"""All queries of the subpackage by name, and SQL for those that SQL can express."""

from . import collocations, conversation_repair, decontaminate, embedding_dedup, html_text, license_scan, line_dedup, lm_scores, near_dedup, piece_codec, quality, suffix_dedup, token_files

_MODULES = (quality, suffix_dedup, html_text, near_dedup, embedding_dedup, token_files, piece_codec, decontaminate, license_scan, lm_scores, collocations, line_dedup, conversation_repair)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
