"""Late usage records taken into the stored tables: only the touched days and keys are summed again.

``medallion.refresh_days`` reads whole months of records. Here the change set is the days and keys of
the late records. Their daily totals are summed again from the records of these days, so distinct
counts stay exact, and their months from the daily totals; all other stored totals are carried over.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline import settings as names
from meterline.operators import billing, usage
from meterline.operators.constraints import enforce
from meterline.operators.usage import USAGE_KEYS
from meterline.plans import medallion
from meterline.session import stored
from meterline.settings import Settings
from meterline.sinks import replace_partitions
from meterline.sources.tables import scan_dataset


def _only(rows: DataFrame, touched: DataFrame, columns: Sequence[str], how: str) -> DataFrame:
    """The rows whose columns are among the touched ones (``left_semi``), or are not; NULL equals NULL."""
    same = F.lit(True)
    for name in columns:
        same = same & F.col(f"r.{name}").eqNullSafe(F.col(f"t.{name}"))
    return rows.alias("r").join(touched.alias("t"), same, how)


def touched_records(records: DataFrame, touched: DataFrame, first, last) -> DataFrame:
    """The stored records of the touched days and keys; only the partitions and days between are read."""
    between = F.col("usage_date").between(first, last) & F.col("usage_month").between(F.trunc(F.lit(first), "month"), F.lit(last))
    return _only(records.filter(between), touched, ("usage_date", *USAGE_KEYS), "left_semi")


def absorb(spark: SparkSession, late: DataFrame, settings: Settings | None = None, on_bad_date: str = "raise") -> DataFrame:
    """Append late usage records and bring daily and monthly totals up to date; returns the monthly table.

    The result equals a full refresh of all records. Records that the rules reject change nothing. Each
    call appends its records, so give them once; if a call fails after that, ``refresh_days`` of
    the same days mends the totals from the source.
    """
    settings = settings or Settings.load(spark)
    bronze, silver, gold = map(settings.qualified, (names.BRONZE_TABLE, names.SILVER_TABLE, settings.gold_table))
    dated = usage.normalise_date(usage.select_existing(late), on_bad_date)
    rows = medallion._in_months(enforce(dated, usage.record_constraints(settings.tenants)))
    rows = stored(rows.filter("usage_date IS NOT NULL"), "late-usage")
    touched = stored(rows.select("usage_date", *USAGE_KEYS).distinct(), "touched-days")
    first, last = touched.agg(F.min("usage_date"), F.max("usage_date")).first()
    if first is None:
        return spark.read.table(gold).select(*billing.GOLD_COLUMNS)
    rows.select(*[f"`{c}`" for c in spark.read.table(bronze).columns]).write.insertInto(bronze)
    spark.catalog.refreshTable(bronze)

    months = F.col("usage_month").between(F.trunc(F.lit(first), "month"), F.lit(last))
    again = usage.daily_usage(touched_records(spark.read.table(bronze), touched, first, last))
    daily = medallion._in_months(enforce(again, usage.DAILY_CONSTRAINTS))
    days = spark.read.table(silver).filter(months)
    kept = _only(days, touched, ("usage_date", *USAGE_KEYS), "left_anti")
    # A partition is written whole, from what is stored of it and the totals that are new.
    merged = stored(kept.unionByName(daily), "merged-days")
    silver_rows = replace_partitions(merged, silver, ("usage_date", "tenant_name"), months)

    periods = touched.select(F.year("usage_date").alias("year"), F.month("usage_date").alias("month"), *USAGE_KEYS).distinct()
    month_keys = ("year", "month", *USAGE_KEYS)
    changed = _only(billing.year_month(silver_rows.filter(months)), periods, month_keys, "left_semi").drop("year", "month")
    priced = medallion.gold(changed, scan_dataset(spark, settings.qualified(settings.price_table)))
    billed = F.make_date("year", "month", F.lit(1)).between(F.trunc(F.lit(first), "month"), F.lit(last))
    others = _only(spark.read.table(gold).filter(billed), periods, month_keys, "left_anti")
    merged = stored(others.unionByName(priced), "merged-months")
    done = replace_partitions(merged, gold, medallion._GOLD_ORDER, billed)
    return done.select(*billing.GOLD_COLUMNS)
