"""Late records taken in by touched days and keys, against a full refresh of all records."""

import datetime

import pytest
from pyspark.sql import functions as F

from meterline import settings as names
from meterline import sinks
from meterline.plans import maintained, medallion
from meterline.settings import Settings

KIND = (
    "record_id long, tenant_name string, sku_name string, usage_date date, usage_unit string, "
    "usage_quantity double, usage_type string, node_type string, region string"
)
PRICE = [("S1", "kr", "small", 0.5), ("S2", "kr", None, 2.0), ("S1", "us", "small", 0.25)]


def record(number, day, tenant="A", sku="S1", quantity=2.0, unit="DBU", node="small", region="kr"):
    return (number, tenant, sku, datetime.date.fromisoformat(day), unit, quantity, "run", node, region)


FIRST = [record(i, f"2024-0{1 + i % 3}-1{i % 7}", "AB"[i % 2], quantity=i / 4, node=None if i % 5 == 0 else "small") for i in range(1, 60)]
LATE = [
    record(1, "2024-02-11"),  # a number that is there on that day already: counted once, its quantity twice
    record(1001, "2024-02-11", node=None),
    record(1002, "2024-02-11", "B", region=None),
    record(1003, "2024-05-30", "A", "S2"),  # a month that is new
    record(1004, "2024-03-16", "A", unit="GB"),  # rejected from the daily totals
    record(1005, "2024-03-16", "C"),  # no listed tenant
    record(None, "2024-03-16"),
    record(1006, "2024-03-16", quantity=-1.0),
]


@pytest.fixture
def store(spark):
    schema = "maintained_tests"
    spark.sql(f"CREATE DATABASE {schema}")
    settings = Settings(f"{schema}.usage_records", ("A", "B"), schema=schema)
    price = spark.createDataFrame(PRICE, "sku_name string, region string, node_type string, usd_per_dbu double")
    sinks.materialize(price, settings.qualified(names.PRICE_TABLE))
    sinks.materialize(spark.createDataFrame(FIRST, KIND), settings.source_table)
    medallion.refresh(spark, settings)
    yield settings
    spark.sql(f"DROP DATABASE {schema} CASCADE")


def contents(spark, settings, rows):
    tables = (names.BRONZE_TABLE, names.SILVER_TABLE, names.GOLD_TABLE)
    return {name: rows(spark.table(settings.qualified(name))) for name in tables}


def test_equals_a_full_refresh(spark, store, rows):
    late = spark.createDataFrame(LATE, KIND)
    untouched = spark.table(store.qualified(names.GOLD_TABLE)).filter("month = 1")
    files = sorted(untouched.select(F.input_file_name()).distinct().collect())
    maintained.absorb(spark, late, store)
    have = contents(spark, store, rows)
    assert files == sorted(spark.table(store.qualified(names.GOLD_TABLE)).filter("month = 1").select(F.input_file_name()).distinct().collect())
    late.write.insertInto(store.source_table)
    medallion.refresh(spark, store)
    assert have == contents(spark, store, rows)


def test_nothing_to_absorb(spark, store, rows):
    before = contents(spark, store, rows)
    none = spark.createDataFrame([record(7, "2024-02-11", "C"), record(None, "2024-02-11")], KIND)
    for late in (none, none.limit(0)):
        found = maintained.absorb(spark, late, store)
        assert rows(found) == rows(spark.table(store.qualified(names.GOLD_TABLE)).select(found.columns))
    assert contents(spark, store, rows) == before


def test_only_touched_days_are_read(spark, store):
    records = spark.table(store.qualified(names.BRONZE_TABLE))
    day = datetime.date(2024, 2, 11)
    touched = spark.createDataFrame([record(1, "2024-02-11")], KIND)
    read = maintained.touched_records(records, touched, day, day)
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)  # filters are shown in full
    try:
        plan = read._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "NestedLoop" not in plan
    assert "GreaterThanOrEqual(usage_date,2024-02-11)" in plan and "LessThanOrEqual(usage_date,2024-02-11)" in plan
    assert "PartitionFilters: [isnotnull(usage_month" in plan
    assert read.count() == records.filter("usage_date = '2024-02-11' AND tenant_name = 'A' AND node_type = 'small'").count()
