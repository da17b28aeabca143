"""The registered queries, each next to the SQL it is checked against."""

from pricemill.catalog.registry import CATALOG
from pricemill.catalog import aggregates, brands, encoding, evaluation, features, models, rows, text  # noqa: F401

__all__ = ["CATALOG"]
