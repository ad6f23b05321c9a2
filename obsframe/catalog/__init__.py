"""All registered queries."""

from obsframe.catalog import agents, corpus, gateway, logs, metrics, sources, streams, traces  # noqa: F401
from obsframe.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
