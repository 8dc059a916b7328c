"""Usage records: tolerant projection, record rules and daily totals."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Literal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.operators.constraints import Constraint, expect_or_drop

# Columns of a usage record, in order.
USAGE_COLUMNS = (
    "record_id",
    "account_id",
    "workspace_id",
    "tenant_name",
    "sku_name",
    "cloud",
    "usage_start_time",
    "usage_end_time",
    "usage_date",
    "usage_unit",
    "usage_quantity",
    "billing_origin_product",
    "usage_type",
    "node_type",
    "region",
)
# What usage is summed by, besides the day or the month.
USAGE_KEYS = ("tenant_name", "sku_name", "usage_type", "usage_unit", "region", "node_type")

# Names and predicates of the rules.
DAILY_CONSTRAINTS = (
    expect_or_drop("usage_unit_is_dbu", "usage_unit = 'DBU'"),
    expect_or_drop("usage_quantity_positive", "total_dbu > 0"),
    expect_or_drop("tenant_not_null", "tenant_name IS NOT NULL"),
    expect_or_drop("usage_date_not_null", "usage_date IS NOT NULL"),
)


def select_existing(df: DataFrame, wanted: Sequence[str] = USAGE_COLUMNS) -> DataFrame:
    """The wanted columns that ``df`` has, in the wanted order; absent ones are left out."""
    present = set(df.columns)
    return df.select([name for name in wanted if name in present])


def tenant_in_list(tenants: Iterable[str]) -> Column:
    """TRUE for listed tenants. An empty list lets only the empty name through."""
    return F.col("tenant_name").isin(list(tenants) or [""])


def record_constraints(tenants: Iterable[str]) -> tuple[Constraint, ...]:
    # Names and predicates of the rules.
    return (
        expect_or_drop("record_id_not_null", "record_id IS NOT NULL"),
        expect_or_drop("usage_quantity_non_negative", "usage_quantity >= 0"),
        expect_or_drop("valid_tenant_name", tenant_in_list(tenants)),
    )


def normalise_date(df: DataFrame, on_bad_date: Literal["raise", "null"] = "raise") -> DataFrame:
    """Turn ``usage_date`` (date, timestamp or text) into a date."""
    if on_bad_date not in ("raise", "null"):
        raise ValueError(f"on_bad_date must be 'raise' or 'null', not {on_bad_date!r}")
    to_day = F.to_date if on_bad_date == "raise" else F.try_to_date
    return df.withColumn("usage_date", to_day(F.col("usage_date")))


def daily_usage(records: DataFrame) -> DataFrame:
    """Quantity and number of distinct records per day and usage key.

    A repeated record id adds its quantity each time and counts once. Spark plans this as
    one exchange on (keys, record_id), which spreads a hot tenant over all tasks, and one
    of the partial totals on the keys.
    """
    return records.groupBy("usage_date", *USAGE_KEYS).agg(
        F.sum("usage_quantity").alias("total_dbu"),
        F.count_distinct("record_id").alias("record_cnt"),
    )
