"""All queries of the training-data operators, and the SQL of those that SQL can express."""

from . import decontaminate, html_text, line_dedup, mixing, paragraph_dedup, ppm, rabitq, simhash, token_store, toxicity

_MODULES = (mixing, line_dedup, simhash, rabitq, paragraph_dedup, token_store, ppm, toxicity, html_text, decontaminate)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
