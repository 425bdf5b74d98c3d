"""All registered queries."""

from panel_engine.catalog.base import ORACLES, QUERIES, Query


def load() -> tuple[dict[str, Query], dict[str, str]]:
    from panel_engine.catalog import aggregates, plans, rows, sources  # noqa: F401  (they register)

    return dict(QUERIES), dict(ORACLES)
