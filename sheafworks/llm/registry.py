"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from sheafworks.llm import clusters, embeddings, fim, fmindex, jaccard, katz, packing, pieces, quality, sharding, suffixes, warc, windows

MODULES = [katz, packing, warc, embeddings, jaccard, sharding, suffixes, windows, pieces, quality, fmindex, fim, clusters]


def queries() -> dict:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
