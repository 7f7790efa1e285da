"""Point lookups, children of a parent, pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowledger.functions.text import all_of

DEFAULT_PAGE = 25
MAX_PAGE = 200


def find(rows: DataFrame, **key) -> DataFrame:
    """Rows whose key columns equal the given values; the filter reaches the file scan."""
    return rows.filter(all_of(*[F.col(c) == F.lit(v) for c, v in key.items()]))


def children(rows: DataFrame, parent: str, order: Sequence[Column | str], parent_id=None) -> DataFrame:
    """Children in stable order: of one parent, or of every parent in one pass."""
    if parent_id is None:
        return rows.orderBy(F.col(parent), *order)
    return find(rows, **{parent: parent_id}).orderBy(*order)


def page_bounds(limit: int = 0, offset: int = 0) -> tuple[int, int]:
    """Page size and start as the read API clamps them."""
    size = DEFAULT_PAGE if limit <= 0 else min(limit, MAX_PAGE)
    return size, max(offset, 0)


def page(rows: DataFrame, order: Sequence[Column], limit: int = 0, offset: int = 0) -> DataFrame:
    """One page in the given order. ``order`` must end in a unique column."""
    size, start = page_bounds(limit, offset)
    return rows.orderBy(*order).offset(start).limit(size)
