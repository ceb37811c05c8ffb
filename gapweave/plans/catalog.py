"""All registered queries."""

from gapweave.plans import queries_prepare, queries_mask, queries_fill, queries_score, queries_check  # noqa: F401, I001
from gapweave.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
