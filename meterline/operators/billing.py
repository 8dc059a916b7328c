"""Monthly totals and their price."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.operators.constraints import expect
from meterline.operators.usage import USAGE_KEYS

# What a price depends on, the monthly result and its stored order.
PRICE_KEYS = ("sku_name", "region", "node_type")
GOLD_COLUMNS = (
    "year",
    "month",
    *USAGE_KEYS,
    "monthly_dbu",
    "est_cost_usd",
    "monthly_records",
)
GOLD_ORDER = ("year", "month", "tenant_name", "sku_name", "node_type")

COST_CONSTRAINTS = (expect("estimated_cost_non_negative", "est_cost_usd >= 0"),)


def year_month(daily: DataFrame) -> DataFrame:
    return daily.withColumns({"year": F.year("usage_date"), "month": F.month("usage_date")})


def monthly_usage(daily: DataFrame) -> DataFrame:
    """Sum the days of a month. ``monthly_records`` adds daily distinct counts up."""
    return daily.groupBy("year", "month", *USAGE_KEYS).agg(
        F.sum("total_dbu").alias("monthly_dbu"),
        F.sum("record_cnt").alias("monthly_records"),
    )


def repeated_price_keys(price: DataFrame) -> DataFrame:
    """Price keys that occur more than once and would multiply the usage rows."""
    return price.groupBy(*PRICE_KEYS).agg(F.count(F.lit(1)).alias("n_prices")).filter("n_prices > 1")


def price_lookup(
    monthly: DataFrame, price: DataFrame, require_unique_price: bool = False
) -> DataFrame:
    """Left join of the price per sku, region and node type.

    A NULL in a key matches nothing, and a key with several prices gives one row for each
    of them. No broadcast hint: Spark broadcasts the price table when its size, known
    beforehand or measured at run time, is below the threshold, and otherwise shuffles
    both sides with skew splitting.
    """
    if require_unique_price and not repeated_price_keys(price).isEmpty():
        raise ValueError("the price table holds several prices for one key")
    return monthly.join(price, list(PRICE_KEYS), "left")


def price_default(priced: DataFrame, default: float = 0.0) -> DataFrame:
    return priced.withColumn("usd_per_dbu", F.coalesce("usd_per_dbu", F.lit(default)))


def estimate_cost(priced: DataFrame) -> DataFrame:
    return priced.withColumn("est_cost_usd", F.col("monthly_dbu") * F.col("usd_per_dbu"))


def gold_projection(costed: DataFrame) -> DataFrame:
    return costed.select(*GOLD_COLUMNS)


def gold_order(gold: DataFrame) -> DataFrame:
    """Global order for showing; a stored table is only sorted within its files."""
    return gold.orderBy(*GOLD_ORDER)


def unpriced_usage(monthly: DataFrame, price: DataFrame) -> DataFrame:
    """Monthly usage without a price, which the cost rule cannot see since it costs 0."""
    keyed = price.filter(F.col("usd_per_dbu").isNotNull()).select(*PRICE_KEYS)
    return monthly.join(keyed, list(PRICE_KEYS), "left_anti")
