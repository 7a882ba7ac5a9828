"""Registered queries of the document engine."""

from quire.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401


def load() -> None:
    """Imports the modules that register queries."""
    from quire.plans import cases, documents, expressions  # noqa: F401
