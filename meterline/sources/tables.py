"""Read tables by name and run SQL text; results stay lazy DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meterline.operators.billing import GOLD_COLUMNS
from meterline.settings import Settings


def scan_dataset(spark: SparkSession, name: str) -> DataFrame:
    """A table or view by name."""
    return spark.read.table(name)


def scan_usage(spark: SparkSession, settings: Settings) -> DataFrame:
    """The usage table that the parameters name."""
    return scan_dataset(spark, settings.source_table)


def query_df(spark: SparkSession, sql_text: str) -> DataFrame:
    return spark.sql(sql_text)


def load_billing_data(spark: SparkSession, settings: Settings, cache: bool = False) -> DataFrame:
    """The columns of the monthly table that reports use; cached if read many times."""
    gold = scan_dataset(spark, settings.qualified(settings.gold_table)).select(*GOLD_COLUMNS)
    return gold.cache() if cache else gold


def use_namespace(spark: SparkSession, catalog: str | None = None, schema: str | None = None) -> None:
    """Set the current catalog and schema, which unqualified names refer to."""
    if catalog:
        spark.catalog.setCurrentCatalog(catalog)
    if schema:
        spark.catalog.setCurrentDatabase(schema)


def find_all_rows(spark: SparkSession, name: str) -> DataFrame:
    """A whole named table, for looking around; pair with ``measures.preview``."""
    return scan_dataset(spark, name)
