"""Named queries."""

from tonelake.plans import catalog, market, records, texts, tone, training  # noqa: F401


def all_queries():
    return catalog.QUERIES


def all_oracles():
    return catalog.ORACLES
