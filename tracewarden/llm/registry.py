"""Queries of this subpackage and their SQL."""

import importlib

MODULES = ("queries_quality", "queries_media", "queries_jaccard", "queries_passages", "queries_decontaminate", "queries_sharding", "queries_mixing", "queries_chat", "queries_toxicity", "queries_warc")

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _name in MODULES:
    _module = importlib.import_module(f"{__package__}.{_name}")
    QUERIES.update(_module.QUERIES)
    SQL.update(_module.SQL)
