"""All registered queries."""

from flowsift.plans import (  # noqa: F401
    catalog_quality,
    catalog_scoring,
    catalog_streams,
    catalog_tickets,
    catalog_training,
)
from flowsift.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
