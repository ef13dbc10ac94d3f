"""All queries of the library and their SQL.

Every query reads the tables of sf_dir; what a table lacks (nodes, versions,
routes) is derived from its columns, so the work grows with the table.
"""

from __future__ import annotations

from . import changes, cluster, documents, metrics, records, requests

_PARTS = (documents, changes, requests, metrics, cluster, records)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
