"""All queries of the core library and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabulon.plans import problems, problems_sql, survey, survey_sql
from tabulon.runtime import Query


def queries() -> dict[str, Query]:
    return {**survey.queries(), **problems.queries()}


def oracle_sql() -> dict[str, str]:
    return {**survey_sql.oracle_sql(), **problems_sql.oracle_sql()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return survey.flagship(spark, folder)
