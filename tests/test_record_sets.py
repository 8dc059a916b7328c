"""Containers of record numbers, merged over days and keys, against counts of the records themselves."""

import random

import pytest
from pyspark.sql import functions as F

from meterline.operators import record_sets as sets

KIND = "record_id string, usage_date string, tenant string, region string"
KEYS = ("usage_date", "tenant", "region")


def random_records(n, seed=0):
    """A third of the rows are of one tenant, records come back on other days, keys and ids may be NULL."""
    draw = random.Random(seed)
    return [
        (
            None if draw.random() < 0.02 else f"r{draw.randrange(n // 2)}",
            f"2024-0{draw.randrange(1, 4)}-1{draw.randrange(4)}",
            draw.choice(["hot", "hot", "a", "b", None, f"t{draw.randrange(20)}"]),
            draw.choice(["kr", "us", None]),
        )
        for _ in range(n)
    ]


def by_hand(records, key):
    found = {}
    for r in records:
        if r[0] is not None:
            found.setdefault(key(r), set()).add(r[0])
    return {k: len(v) for k, v in found.items()}


@pytest.mark.parametrize("listed", [0, 3, 40, 1024], ids=["bitmaps only", "both", "mostly lists", "default"])
def test_counts_of_any_period_equal_those_of_the_records(spark, listed):
    records = random_records(3000)
    frame = spark.createDataFrame(records, KIND).repartition(5)
    numbers = sets.number_records(frame, order=KEYS)
    assert numbers.select("record_no").distinct().count() == numbers.count() == len({r[0] for r in records} - {None})
    days = sets.record_sets(frame, numbers, KEYS, max_listed=listed)
    assert all((d.bits is None) == (d.n <= listed) and (d.positions is None) != (d.bits is None) for d in days.collect())
    found = {(r.usage_date, r.tenant, r.region): r.n_records for r in sets.count_records(days, KEYS).collect()}
    assert found == by_hand(records, lambda r: r[1:])

    months = days.withColumn("month", F.substring("usage_date", 1, 7))
    want = by_hand(records, lambda r: (r[1][:7], r[2]))
    found = {(r.month, r.tenant): r.n_records for r in sets.count_records(months, ("month", "tenant")).collect()}
    assert found == want and sum(want.values()) < sum(by_hand(records, lambda r: r[1:]).values())
    merged = sets.merge_record_sets(months, ("month", "tenant"), max_listed=listed)
    assert {(r.month, r.tenant): r.n_records for r in sets.count_records(merged, ("month", "tenant")).collect()} == want
    found = {r.tenant: r.n_records for r in sets.count_records(merged, ("tenant",)).collect()}  # merged ones merge again
    assert found == by_hand(records, lambda r: r[2])


def test_late_records_keep_known_numbers(spark):
    first, late = random_records(500), random_records(700, seed=1)
    one, two = (spark.createDataFrame(rows, KIND) for rows in (first, late))
    known = sets.number_records(one, order=KEYS)
    every = sets.number_records(two, known, order=KEYS)
    held = {r.record_id: r.record_no for r in every.collect()}
    assert held.items() >= {r.record_id: r.record_no for r in known.collect()}.items()
    assert len(set(held.values())) == len(held) == len({r[0] for r in first + late} - {None})
    both = sets.record_sets(one, known, KEYS).unionByName(sets.record_sets(two, every, KEYS))
    found = {r.tenant: r.n_records for r in sets.count_records(both, ("tenant",)).collect()}
    assert found == by_hand(first + late, lambda r: r[2])


def test_no_records(spark):
    none = spark.createDataFrame([], KIND)
    numbers = sets.number_records(none, order=KEYS)
    assert numbers.count() == 0 and sets.number_records(none, numbers, order=KEYS).count() == 0
    days = sets.record_sets(none, numbers, KEYS)
    assert days.count() == 0 and sets.count_records(days, ("tenant",)).count() == 0
    assert sets.merge_record_sets(days, ("tenant",)).count() == 0


def test_numbers_of_a_key_are_close_together(spark):
    """Every record of a day in its own bucket would need a bitmap or list for each; sorted by key they share them."""
    rows = [(f"r{i * 7919 % 20000}", f"2024-01-{10 + i % 20}", "t", "kr") for i in range(20000)]
    frame = spark.createDataFrame(rows, KIND).repartition(8)
    days = sets.record_sets(frame, sets.number_records(frame, order=KEYS), KEYS)
    assert days.count() <= 20 + spark.sparkContext.defaultParallelism * 2


@pytest.mark.parametrize("query", ["daily_record_sets", "distinct_records"])
def test_records_are_made_once(spark, monkeypatch, query):
    """Numbering and containers share the stored records; the joins behind them run once."""
    from meterline.registry import inputs
    from meterline.registry.queries import QUERIES

    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(region):
        made.add(1)
        return region

    records = [(i * 10 + j, "BUILDING", f"sku{i % 3}", f"2024-0{1 + i % 2}-{16 + j}", 1.0 + j, "kr" if i % 4 else "us") for i in range(40) for j in range(3)]
    columns = "record_id long, tenant_name string, sku_name string, usage_date string, usage_quantity double, region string"
    frame = spark.createDataFrame(records, columns).withColumns(
        {"region": seen("region"), "usage_unit": F.lit("DBU"), "usage_type": F.lit("F"), "node_type": F.lit(None).cast("string")}
    )
    monkeypatch.setattr(inputs, "usage", lambda spark, sf_dir: frame)
    found = QUERIES[query](spark, "").collect()
    assert made.value == len(records)
    if query == "distinct_records":
        assert {(r.region, r.n_records) for r in found} == {("kr", 30), ("us", 10)}


def test_positions_are_gathered_in_one_shuffle(spark, monkeypatch):
    """Not made distinct, counted and listed in three; a repeated position counts once."""
    plans = []

    def noted(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(sets, "stored", noted)
    single = spark.createDataFrame([("a", 0, 5), ("a", 0, 5), (None, 0, 1), ("a", 1, 7)], "tenant string, bucket long, position int")
    found = sets._contained(single, None, ("tenant",), 10)
    assert {(r.tenant, r.bucket): r.positions for r in found.collect()} == {("a", 0): [5], (None, 0): [1], ("a", 1): [7]}
    assert plans[0].count("Exchange hashpartitioning") == 1
