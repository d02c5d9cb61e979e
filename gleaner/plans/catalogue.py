"""The named queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleaner.plans import collected, core, dossiers, extras, gates, graph, intake, lookups, orthography, records, texts  # noqa: F401  register their queries
from gleaner.plans.registry import ORACLE, QUERIES

FLAGSHIP = "gate4_priority"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
