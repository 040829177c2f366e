"""All queries of the library with their SQL equivalents."""

from __future__ import annotations

from .plans import benchmark, curation, documents, evaluation, legal, records

PLANS = (evaluation, benchmark, curation, documents, legal, records)


def queries():
    return {n: f for p in PLANS for n, f in p.QUERIES.items()}


def oracle_sql():
    return {n: q for p in PLANS for n, q in p.SQL.items()}
