"""Totals and rankings over a filtered monthly table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.operators.usage import USAGE_KEYS

COST = "est_cost_usd"


def _total() -> Column:
    return F.coalesce(F.sum(COST), F.lit(0.0))


def _latest(value: str) -> Column:
    return F.coalesce(F.max_by(value, F.struct("year", "month")), F.lit(0.0))


def total_cost(rows: DataFrame) -> DataFrame:
    """Sum of the cost, 0 for no rows."""
    return rows.agg(_total().alias("total_cost"))


def _row_order() -> Column:
    """Places a row by month, then by its keys; NULL keys come before others."""
    text = [F.coalesce(F.col(key).cast("string"), F.lit("")) for key in USAGE_KEYS]
    known = [F.col(key).isNotNull() for key in USAGE_KEYS]
    keys = [one for pair in zip(known, text, strict=True) for one in pair]
    return F.struct("year", "month", *keys)


def last_row(rows: DataFrame) -> DataFrame:
    """The whole last row by year, month and the six keys; no rows give none."""
    keys = [F.desc_nulls_last(key) for key in USAGE_KEYS]
    return rows.orderBy(F.desc_nulls_last("year"), F.desc_nulls_last("month"), *keys).limit(1)


def recent_row_cost(rows: DataFrame) -> DataFrame:
    """Cost of the row that ``last_row`` gives, 0 for no rows; a maximum, so nothing is sorted."""
    dated = F.when(F.col("year").isNotNull() & F.col("month").isNotNull(), _row_order())
    return rows.agg(F.coalesce(F.max_by(COST, dated), F.lit(0.0)).alias("recent_cost"))


def last_period_cost(rows: DataFrame) -> DataFrame:
    """Cost of the whole latest month; 0 for no rows."""
    months = rows.groupBy("year", "month").agg(_total().alias("cost"))
    return months.agg(_latest("cost").alias("last_period_cost"))


def active_tenants(rows: DataFrame, approximate: bool = False) -> DataFrame:
    """Number of distinct non-null tenants."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return rows.agg(count(F.col("tenant_name")).alias("active_tenants"))


def kpi_row(rows: DataFrame) -> DataFrame:
    """The three header figures in one pass: by tenant and month first, then over those."""
    months = rows.groupBy("tenant_name", "year", "month").agg(
        F.sum(COST).alias(COST), F.max(F.struct(_row_order().alias("place"), COST)).alias("row")
    )
    periods = months.groupBy("tenant_name").agg(
        F.sum(COST).alias(COST),
        F.max("row").alias("latest"),
    )
    return periods.agg(
        _total().alias("total_cost"),
        F.coalesce(F.max("latest")[COST], F.lit(0.0)).alias("recent_cost"),
        F.count("tenant_name").alias("active_tenants"),
    )


def cost_by_tenant(rows: DataFrame) -> DataFrame:
    """Cost per non-null tenant."""
    named = rows.filter("tenant_name IS NOT NULL")
    return named.groupBy("tenant_name").agg(_total().alias(COST))


def top_tenants(rows: DataFrame, n: int | None = None) -> DataFrame:
    """Tenants by falling cost; with ``n`` only the first ``n`` of them."""
    ranked = cost_by_tenant(rows).orderBy(F.desc(COST), "tenant_name")
    return ranked if n is None else ranked.limit(n)


def detail_rows(rows: DataFrame) -> DataFrame:
    return rows.orderBy("year", "month", "tenant_name")


def preview(rows: DataFrame, n: int = 5) -> DataFrame:
    return rows.limit(n)
