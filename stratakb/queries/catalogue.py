"""The registered queries of the core library and the SQL that gives the same rows.

Every query reads whole tables; ages are taken on AS_OF so that results repeat.
"""

from __future__ import annotations

from stratakb.queries import breadth, documents, evaluate, files, fusion, search

MODULES = (documents, search, fusion, evaluate, breadth, files)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
