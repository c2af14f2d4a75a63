"""All registered queries of the reference's own operators and their SQL."""

from __future__ import annotations

from sheafworks.plans import image_queries, page_queries

MODULES = [page_queries, image_queries]


def queries() -> dict:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
