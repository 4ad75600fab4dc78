"""All registered queries and oracles."""

from isohyet.plans import maps, outlook, relational, scalars, workflow_queries  # noqa: F401
from isohyet.plans.fixtures import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
