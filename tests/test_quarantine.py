"""Kept and rejected rows of one pass, counts from what is stored, and partitions taken from the catalog."""

import datetime

import pytest
from pyspark.sql import functions as F

from meterline import sinks
from meterline.operators.constraints import expect, expect_or_drop, violations
from meterline.plans import quarantine

RULES = (
    expect_or_drop("id_known", "id IS NOT NULL"),
    expect_or_drop("amount_positive", "amount > 0"),
    expect("amount_small", "amount < 100"),
)
ROWS = [(1, 5.0), (2, 500.0), (None, 5.0), (None, -1.0), (4, None), (5, 0.0), (6, 7.0), (6, 7.0), (None, None)]


@pytest.fixture
def schema(spark):
    name = "quarantine_tests"
    spark.sql(f"CREATE DATABASE {name}")
    yield name
    spark.sql(f"DROP DATABASE {name} CASCADE")


def test_nothing_is_lost_and_counts_agree(spark, schema, rows):
    given = spark.createDataFrame(ROWS, "id int, amount double").repartition(3)
    split = quarantine.store_split(given, RULES, f"{schema}.judged")
    assert split.kept.columns == given.columns
    assert rows(split.kept.union(split.rejected.drop(quarantine.BROKEN))) == rows(given)
    assert rows(split.kept) == [(1, 5.0), (2, 500.0), (6, 7.0), (6, 7.0)]
    broken = {(r.id, r.amount): r.broken_rules for r in split.rejected.collect()}
    assert broken == {
        (None, 5.0): ["id_known"],
        (None, -1.0): ["id_known", "amount_positive"],
        (4, None): ["amount_positive", "amount_small"],
        (5, 0.0): ["amount_positive"],
        (None, None): ["id_known", "amount_positive", "amount_small"],
    }
    # A kept row may break a rule that only warns.
    assert split.judged.filter("id = 2").first()[quarantine.BROKEN] == ["amount_small"]
    counts = quarantine.rule_counts(split, RULES, "bronze", "r1")
    want = {(r.constraint, r.action, r.n_rows, r.n_failed) for r in violations(given, RULES).collect()}
    assert {(r.constraint, r.action, r.n_rows, r.n_failed) for r in counts.collect()} == want


def test_one_scan_and_pruned_readers(spark, schema):
    given = spark.createDataFrame(ROWS, "id int, amount double")
    split = quarantine.store_split(given, RULES, f"{schema}.judged")
    for part in (split.kept, split.rejected):
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(rejected" in plan or "PartitionFilters: [" in plan and "rejected" in plan
    again = quarantine.store_split(given.filter("id = 1"), RULES, f"{schema}.judged")
    assert again.kept.count() == 1 and again.rejected.count() == 0  # the rejected rows of before are gone


def test_history_keeps_one_copy_of_a_refresh(spark, schema, rows):
    given = spark.createDataFrame(ROWS, "id int, amount double")
    for refresh_id, part in (("a/1", given), ("b 2", given.limit(3)), ("b 2", given.limit(4))):
        split = quarantine.store_split(part, RULES, f"{schema}.judged")
        stored = quarantine.record_history(quarantine.rule_counts(split, RULES, "bronze", refresh_id), f"{schema}.history")
        quarantine.record_history(quarantine.rule_counts(split, RULES[:1], "silver", refresh_id), f"{schema}.history")
    found = rows(stored.select("refresh_id", "stage", "constraint", "n_rows"))
    names = [r.name for r in RULES]
    assert found == sorted(
        [(i, "bronze", name, n) for i, n in (("a/1", 9), ("b 2", 4)) for name in names]
        + [(i, "silver", names[0], n) for i, n in (("a/1", 9), ("b 2", 4))],
        key=repr,
    )


def test_clashing_columns_and_no_rules(spark, schema):
    given = spark.createDataFrame(ROWS, "id int, amount double")
    with pytest.raises(ValueError, match="broken_rules"):
        quarantine.judged(given.withColumn("broken_rules", F.lit(1)), RULES)
    assert quarantine.judged(given, ()).filter("NOT rejected AND size(broken_rules) = 0").count() == len(ROWS)


def test_partitions_that_lost_their_rows(spark, schema, rows):
    """Dates, NULL and awkward text as partition values; nothing is read but the catalog's list."""
    table = f"{schema}.parts"
    day = datetime.date(2024, 1, 31)
    given = [(day, "a/b=c %", 1), (day, None, 2), (None, "a", 3), (datetime.date(2024, 2, 1), "", 4), (day, "x'y", 5)]
    kind = "day date, name string, n int"
    frame = spark.createDataFrame(given, kind).select("n", "day", "name")
    stored = sinks.materialize(frame, table, partition_by=("day", "name"))
    assert len(sinks._stored_partitions(spark, table)) == 5
    kept = frame.filter("n IN (1, 4)")
    stored = sinks.materialize(kept, table, partition_by=("day", "name"))
    assert [r.n for r in stored.orderBy("n").collect()] == [1, 4]
    late = spark.createDataFrame([(day, "new", 6)], kind).select("n", "day", "name")
    stored = sinks.replace_partitions(late, table, within=F.col("day") == "2024-01-31")
    assert [r.n for r in stored.orderBy("n").collect()] == [4, 6]
    stored = sinks.replace_partitions(late.limit(0), table, within=F.col("day").isNotNull() & (F.col("name") == "new"))
    assert [r.n for r in stored.collect()] == [4]
