"""The queries of this subpackage, one ``opN_<name>`` for each operator, and the SQL twins of those SQL can express."""

from __future__ import annotations

from importlib import import_module

#: Operator modules; each has QUERY, query(spark, sf_dir) and ORACLE_SQL (None where SQL can't express it).
MODULES = ("url_filter", "packing", "quality", "line_dedup", "bitplane", "html_extract", "ngram_join", "media", "chat_format", "decontaminate")


def _operators():
    return [import_module(f"pixelquarry.llm.{name}") for name in MODULES]


def queries():
    return {m.QUERY: m.query for m in _operators()}


def oracle_sql():
    return {m.QUERY: m.ORACLE_SQL for m in _operators() if m.ORACLE_SQL is not None}
