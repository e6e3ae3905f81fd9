"""All queries of the library proper, by name, with the SQL that each is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from papyra import registry
from papyra.plans import edit_plans, extension_plans, library_plans, ranking_plans, search_plans, state_plans, store_plans, structure_plans, text_plans, view_plans  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.QUERIES["library_phrase_search"](spark, sf_dir)


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
