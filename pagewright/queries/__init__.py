"""Every registered query of the layout and table operators, with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


def all_queries() -> dict[str, Query]:
    from pagewright.queries import blocks, grids, layouts, scalars, signals, storage, tables

    found: dict[str, Query] = {}
    for module in (scalars, blocks, layouts, signals, tables, grids, storage):
        assert not found.keys() & module.QUERIES.keys()
        found |= module.QUERIES
    return found
