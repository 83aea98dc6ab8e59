"""All registered queries; importing a family registers its queries."""

from feedloom.plans import activity, documents, listing, reconciling, streams, texts  # noqa: F401
from feedloom.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
