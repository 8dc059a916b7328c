"""Usage records to daily and monthly billing, as one lazy plan or as stored tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline import settings as names
from meterline.operators import billing, usage
from meterline.operators.constraints import Constraint, enforce, enforce_observed
from meterline.settings import Settings
from meterline.sinks import RESET_ALLOWED, materialize, replace_partitions
from meterline.sources.tables import scan_dataset, scan_usage

_GUARD = {RESET_ALLOWED: "false"}
_USAGE_MONTH, _MONTH = ("usage_month",), ("year", "month")
_GOLD_ORDER = ("tenant_name", "sku_name", "node_type")
BRONZE_COMMENT = "Usage records of listed tenants that pass the record rules."
SILVER_COMMENT = "Daily usage per tenant, SKU, usage type, region and node type."
GOLD_COMMENT = "Monthly usage and estimated cost per tenant."


def bronze(records: DataFrame, tenants: Iterable[str]) -> DataFrame:
    """Usage records that pass the record rules."""
    return enforce(usage.select_existing(records), usage.record_constraints(tenants))


def silver(bronze_rows: DataFrame, on_bad_date: str = "raise") -> DataFrame:
    """Daily usage; the rules apply to the daily totals."""
    daily = usage.daily_usage(usage.normalise_date(bronze_rows, on_bad_date))
    return enforce(daily, usage.DAILY_CONSTRAINTS)


def gold(silver_rows: DataFrame, price: DataFrame, require_unique_price: bool = False) -> DataFrame:
    """Monthly usage with its estimated cost."""
    monthly = billing.monthly_usage(billing.year_month(silver_rows))
    priced = billing.price_default(billing.price_lookup(monthly, price, require_unique_price))
    return billing.gold_projection(billing.estimate_cost(priced))


def monthly_billing(records: DataFrame, price: DataFrame, tenants: Iterable[str]) -> DataFrame:
    """All three stages in one plan, nothing stored between them."""
    return gold(silver(bronze(records, tenants)), price)


@dataclass(frozen=True)
class Refreshed:
    """The stored monthly table, and ``constraint, stage, action, n_rows, n_failed`` of each rule."""

    gold: DataFrame
    report: DataFrame


REPORT = "constraint string, stage string, action string, n_rows bigint, n_failed bigint"


class _Stage:
    """Rules of one stage, counted while its table is written."""

    def __init__(self, name: str, rules: Iterable[Constraint]):
        self.name, self.rules = name, list(rules)

    def rows(self, df: DataFrame) -> DataFrame:
        kept, self.counts = enforce_observed(df, self.rules, f"{self.name}-{uuid.uuid4().hex}")
        return kept

    def report(self) -> list[tuple]:
        found = self.counts.get
        return [(r.name, self.name, r.action, found["n_rows"], found[r.name]) for r in self.rules]


def refresh_reported(
    spark: SparkSession,
    settings: Settings | None = None,
    reset: bool = False,
    on_bad_date: str = "raise",
    require_unique_price: bool = False,
) -> Refreshed:
    """Recompute and store the three tables; the rules are counted in the pass that writes each.

    Every stage reads the stored one before it, so a lost executor costs tasks of one stage.
    All are partitioned by month, which ``refresh_days`` replaces and period filters prune, and
    are in the catalog and schema that are set.
    """
    settings = settings or Settings.load(spark)
    records = _Stage("bronze", usage.record_constraints(settings.tenants))
    dated = usage.normalise_date(usage.select_existing(scan_usage(spark, settings)), on_bad_date)
    stored_bronze = materialize(
        _in_months(records.rows(dated)), settings.qualified(names.BRONZE_TABLE), BRONZE_COMMENT, _GUARD,
        partition_by=_USAGE_MONTH, reset=reset,
    )
    daily = _Stage("silver", usage.DAILY_CONSTRAINTS)
    stored_silver = materialize(
        _in_months(daily.rows(usage.daily_usage(stored_bronze))), settings.qualified(names.SILVER_TABLE), SILVER_COMMENT,
        _GUARD, partition_by=_USAGE_MONTH, sort_by=("usage_date", "tenant_name"), reset=reset,
    )
    costs = _Stage("gold", billing.COST_CONSTRAINTS)
    price = scan_dataset(spark, settings.qualified(settings.price_table))
    stored_gold = materialize(
        costs.rows(gold(stored_silver, price, require_unique_price)), settings.qualified(settings.gold_table),
        GOLD_COMMENT, _GUARD, partition_by=_MONTH, sort_by=_GOLD_ORDER, reset=reset,
    )
    found = [row for stage in (records, daily, costs) for row in stage.report()]
    return Refreshed(stored_gold.select(*billing.GOLD_COLUMNS), spark.createDataFrame(found, REPORT))


def refresh(spark: SparkSession, settings: Settings | None = None, reset: bool = False, **how) -> DataFrame:
    """``refresh_reported`` without its report; returns the monthly table."""
    return refresh_reported(spark, settings, reset, **how).gold


def _in_months(rows: DataFrame) -> DataFrame:
    return rows.withColumn(_USAGE_MONTH[0], F.trunc("usage_date", "month"))


def refresh_days(
    spark: SparkSession, first: str, last: str, settings: Settings | None = None, on_bad_date: str = "raise"
) -> DataFrame:
    """Take in the usage of some days again: only the months of these days are rewritten.

    A month of these that has lost all its rows loses the stored ones too.
    """
    settings = settings or Settings.load(spark)
    begin, end = F.lit(first).cast("date"), F.lit(last).cast("date")
    dated = usage.normalise_date(usage.select_existing(scan_usage(spark, settings)), on_bad_date)
    wanted = dated.filter(F.col("usage_date").between(F.trunc(begin, "month"), F.last_day(end)))
    records = _in_months(enforce(wanted, usage.record_constraints(settings.tenants)))
    months = F.col("usage_month").between(F.trunc(begin, "month"), end)
    stored_bronze = replace_partitions(records, settings.qualified(names.BRONZE_TABLE), within=months)
    daily = _in_months(enforce(usage.daily_usage(stored_bronze.filter(months)), usage.DAILY_CONSTRAINTS))
    order = ("usage_date", "tenant_name")
    stored_silver = replace_partitions(daily, settings.qualified(names.SILVER_TABLE), order, months)
    price = scan_dataset(spark, settings.qualified(settings.price_table))
    rows = gold(stored_silver.filter(months), price)
    billed = F.make_date(*_MONTH, F.lit(1)).between(F.trunc(begin, "month"), end)
    stored = replace_partitions(rows, settings.qualified(settings.gold_table), _GOLD_ORDER, billed)
    return stored.select(*billing.GOLD_COLUMNS)
