"""All queries of the library with their SQL."""

from __future__ import annotations

from . import extra, logs, more, policy, search, tables  # noqa: F401
from .tables import QUERIES, SQL

FLAGSHIP = "pagerank_pages"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
