"""All queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from pagewright.llm import encoding, language, main_body, mixing, near_duplicates, packing, residue, sentences, site_lines

_MODULES = [encoding, near_duplicates, residue, site_lines, main_body, language, packing, mixing, sentences]

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in getattr(m, "ORACLE", {}).items()}
