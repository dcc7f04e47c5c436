"""The subpackage's registered queries and their SQL."""

from rillstack.llm import decontaminate, html_extract, importance, jaccard_join, line_dedup, lm_scoring, mixing, ordinal_quality, periodic_runs, quality_rules, secret_scan, suffix_dedup, url_filter

_MODULES = [suffix_dedup, secret_scan, quality_rules, line_dedup, url_filter, mixing, html_extract, decontaminate, jaccard_join, ordinal_quality, periodic_runs, importance, lm_scoring]
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
