"""Every query of the reference's own operators, by name, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from webloom.plans.catalog_plans import CATALOG
from webloom.plans.dedup_plans import DEDUP
from webloom.plans.graph_plans import GRAPH
from webloom.plans.scalar_plans import SCALAR
from webloom.plans.search_plans import FLAGSHIP, SEARCH
from webloom.plans.state_plans import STATE

_ALL = {**SEARCH, **SCALAR, **CATALOG, **DEDUP, **GRAPH, **STATE}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FLAGSHIP(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
