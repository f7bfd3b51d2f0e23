"""The queries of this folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from corpusloom.llm import chat, codes, decontaminate, dialogue, html, jaccard, language, lines, mixing, neighbours, quality, secrets, urls

MODULES = (secrets, jaccard, urls, chat, language, lines, html, mixing, quality, decontaminate, neighbours, codes, dialogue)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
