"""All registered queries."""

from punctual.queries import history, learning, pipeline, profile, resolving, tables, values  # noqa: F401
from punctual.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
