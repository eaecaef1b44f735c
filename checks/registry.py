"""Where queries and their SQL are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.derive import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of ``Tables`` under a name, with the SQL that must give the same rows."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"two queries are called {name}")
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def money(value: Column | str) -> Column:
    """A decimal as DOUBLE, the type both engines compare exactly."""
    return (F.col(value) if isinstance(value, str) else value).cast("decimal(18,4)").cast("double")


def money_sql(value: str) -> str:
    return f"CAST(CAST({value} AS DECIMAL(18,4)) AS DOUBLE)"


def iso(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("string")


def separators_sql(text: str) -> str:
    """The one-decimal-point rule in SQL."""
    return (
        f"CASE WHEN regexp_matches({text}, '\\.[^.,]{{0,2}}$') THEN replace({text}, ',', '') "
        f"WHEN regexp_matches({text}, ',[^.,]{{0,2}}$') THEN replace(replace({text}, '.', ''), ',', '.') "
        f"ELSE replace(replace({text}, ',', ''), '.', '') END"
    )


def decimal_sql(text: str) -> str:
    """The display rule in SQL: digits, signs and separators only; a trailing minus moves to the front."""
    kept = f"regexp_replace({text}, '[^\\d\\-.,]', '', 'g')"
    moved = f"(CASE WHEN {kept} LIKE '%-' AND {kept} NOT LIKE '-%' THEN '-' || {kept}[:-2] ELSE {kept} END)"
    return f"TRY_CAST({separators_sql(moved)} AS DECIMAL(38,10))"


def compare_sql(text: str) -> str:
    return f"TRY_CAST(replace(regexp_replace({text}, '[^\\d\\-.,]', '', 'g'), ',', '') AS DECIMAL(38,10))"


def format_money_sql(number: str) -> str:
    """'1,234.50' of a number in SQL."""
    return f"format('{{:,.2f}}', CAST({number} AS DOUBLE))"


def id_key_sql(text: str) -> str:
    return f"regexp_replace(upper({text}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
