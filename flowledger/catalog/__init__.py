"""All registered queries. Importing the package fills the registry."""

from flowledger.catalog import content, counted, filters, graphs, joined, ranked, scalars, scheduled, stored, streams, views  # noqa: F401
from flowledger.catalog.core import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
