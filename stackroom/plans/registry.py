"""All catalog queries by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stackroom.plans import catalog, curation, durability, scanning  # noqa: F401  they register their queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(catalog.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalog.ORACLES)
