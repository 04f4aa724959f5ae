"""Named queries over the driver's tables, each with its DuckDB text where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import campaign_plans, evaluation_plans, evidence_plans, observation_plans, price_plans, release_plans, text_plans, tree_plans, validation_plans

PLANS = (price_plans, text_plans, evaluation_plans, tree_plans, validation_plans, observation_plans, evidence_plans, campaign_plans, release_plans)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for m in PLANS for name, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for m in PLANS for name, sql in m.ORACLE_SQL.items()}
