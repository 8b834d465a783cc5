"""Registered queries, one module per operator family."""

from barline.plans.catalog import (  # noqa: F401
    evaluation,
    joins,
    ops,
    research_queries,
    scalars,
    source_queries,
    streams,
    windows,
)
from barline.plans.catalog.base import ORACLES, QUERIES
from barline.plans.catalog.evaluation import flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]
