"""Record rules, daily and monthly totals, and prices, on literal rows."""

import datetime
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meterline.operators import billing, usage
from meterline.operators.constraints import (
    enforce,
    enforce_observed,
    expect,
    expect_or_drop,
    violations,
)
from meterline.plans import medallion

SCHEMA = (
    "record_id string, tenant_name string, sku_name string, usage_type string, usage_unit string, "
    "region string, node_type string, usage_date string, usage_quantity double"
)
DAY = datetime.date(2024, 1, 31)


def record(record_id="r1", tenant="T", quantity=1.0, date="2024-01-31", unit="DBU", node="small"):
    return (record_id, tenant, "sku", "compute", unit, "kr", node, date, quantity)


@pytest.fixture
def records(spark):
    return lambda *given: spark.createDataFrame(list(given), SCHEMA)


@pytest.fixture
def prices(spark):
    def make(*given, kind="double"):
        schema = f"sku_name string, region string, node_type string, usd_per_dbu {kind}"
        return spark.createDataFrame(list(given), schema)

    return make


def test_select_existing_keeps_wanted_order_and_skips_absent(spark):
    df = spark.createDataFrame([(1, "x", "T", 2.0)], "region int, other string, tenant_name string, usage_quantity double")
    assert usage.select_existing(df).columns == ["tenant_name", "usage_quantity", "region"]


def test_bronze_drops_null_negative_and_unlisted(records):
    df = records(
        record("good"),
        record(None),
        record("null-quantity", quantity=None),
        record("negative", quantity=-1.0),
        record("zero", quantity=0.0),
        record("other", tenant="X"),
        record("null-tenant", tenant=None),
    )
    kept = medallion.bronze(df, ["T"])
    assert {r.record_id for r in kept.collect()} == {"good", "zero"}


def test_empty_tenant_list_keeps_only_the_empty_name(records):
    df = records(record("a"), record("b", tenant=""), record("c", tenant=None))
    assert [r.record_id for r in df.filter(usage.tenant_in_list([])).collect()] == ["b"]


def test_tenant_names_with_quotes(records):
    df = records(record("a", tenant="O'Hara"), record("b"))
    assert [r.record_id for r in medallion.bronze(df, ["O'Hara"]).collect()] == ["a"]


def test_repeated_record_is_summed_and_counted_once(records):
    df = records(record("a", quantity=2.0), record("a", quantity=3.0), record("b", quantity=4.0))
    daily = medallion.silver(df).first()
    assert (daily.usage_date, daily.total_dbu, daily.record_cnt) == (DAY, 9.0, 2)


def test_record_on_two_days_counts_twice_in_the_month(records, prices):
    df = records(record("a", date="2024-01-30"), record("a", date="2024-01-31"))
    gold = medallion.monthly_billing(df, prices(("sku", "kr", "small", 0.5)), ["T"]).first()
    assert (gold.monthly_records, gold.monthly_dbu, gold.est_cost_usd) == (2, 2.0, 1.0)


def test_silver_rules_apply_to_daily_totals(records):
    df = records(
        record("a", quantity=0.0, date="2024-01-01"),
        record("b", quantity=0.0, date="2024-01-02"),
        record("c", quantity=1.0, date="2024-01-02"),
        record("d", unit="GB"),
        record("e", date=None),
    )
    daily = medallion.silver(df).collect()
    assert [(str(r.usage_date), r.total_dbu, r.record_cnt) for r in daily] == [("2024-01-02", 1.0, 2)]


def test_null_keys_form_a_group(records):
    df = records(record("a", node=None), record("b", node=None))
    assert [(r.node_type, r.total_dbu) for r in medallion.silver(df).collect()] == [(None, 2.0)]


def test_bad_dates_raise_or_become_null(records):
    df = records(record("a", date="no date"), record("b"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|no date"):
        usage.normalise_date(df).collect()
    assert [r.usage_date for r in medallion.silver(df, on_bad_date="null").collect()] == [DAY]
    with pytest.raises(ValueError):
        usage.normalise_date(df, on_bad_date="skip")


def test_timestamps_become_dates(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-31 23:59:59' AS usage_date")
    assert usage.normalise_date(df).first().usage_date == DAY


def test_price_null_keys_do_not_match_and_cost_nothing(records, prices):
    df = records(record("a", node=None), record("b", node="huge"), record("c"))
    price = prices(("sku", "kr", None, 9.0), ("sku", "kr", "small", 0.25))
    gold = medallion.monthly_billing(df, price, ["T"])
    assert {(r.node_type, r.est_cost_usd) for r in gold.collect()} == {
        (None, 0.0),
        ("huge", 0.0),
        ("small", 0.25),
    }


def test_repeated_price_keys_multiply_rows_or_raise(records, prices):
    price = prices(("sku", "kr", "small", 1.0), ("sku", "kr", "small", 2.0))
    silver = medallion.silver(records(record("a")))
    assert sorted(r.est_cost_usd for r in medallion.gold(silver, price).collect()) == [1.0, 2.0]
    with pytest.raises(ValueError, match="several prices"):
        medallion.gold(silver, price, require_unique_price=True)


def test_decimal_price_gives_double_cost(records, prices):
    price = prices(("sku", "kr", "small", Decimal("0.50")), kind="decimal(10,2)")
    gold = medallion.monthly_billing(records(record("a")), price, ["T"])
    assert dict(gold.dtypes)["est_cost_usd"] == "double"
    assert gold.first().est_cost_usd == 0.5


def test_gold_columns_and_unpriced_usage(records, prices):
    price = prices(("sku", "kr", "small", None)).withColumn("note", F.lit("dropped"))
    silver = medallion.silver(records(record("a")))
    assert medallion.gold(silver, price).columns == list(billing.GOLD_COLUMNS)
    monthly = billing.monthly_usage(billing.year_month(silver))
    assert billing.unpriced_usage(monthly, price).count() == 1


def test_days_and_months_add_up_to_the_same_usage(spark):
    from meterline.registry import inputs
    from tests.conftest import SF_DIR

    silver = inputs.silver(spark, SF_DIR)
    gold = medallion.gold(silver, inputs.price(spark, SF_DIR))
    monthly = billing.monthly_usage(billing.year_month(silver))
    days = silver.agg(F.sum("total_dbu"), F.sum("record_cnt")).first()
    months = gold.agg(F.sum("monthly_dbu"), F.sum("monthly_records")).first()
    assert tuple(days) == tuple(months)
    assert gold.count() == monthly.count()


def test_constraint_actions_and_counts(spark):
    df = spark.createDataFrame([(1,), (-1,), (None,)], "x int")
    rules = [expect_or_drop("known", "x IS NOT NULL"), expect("positive", F.col("x") > 0)]
    assert enforce(df, rules).count() == 2
    assert [tuple(r) for r in violations(df, rules).collect()] == [
        ("known", "drop", 3, 1),
        ("positive", "warn", 3, 2),
    ]
    kept, metrics = enforce_observed(df, rules, "check")
    assert kept.count() == 2
    assert metrics.get == {"n_rows": 3, "known": 1, "positive": 2}


def test_violations_of_an_empty_frame(spark):
    df = spark.createDataFrame([], "x int")
    assert [tuple(r) for r in violations(df, [expect("any", "x > 0")]).collect()] == [("any", "warn", 0, 0)]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_records_match_pandas(spark, seed, rows):
    """A third of the records belong to one group, and half of those repeat one record."""
    random = np.random.default_rng(seed)
    n = 3000
    pick = lambda *values: random.choice(np.array(values, dtype=object), n)
    frame = pd.DataFrame(
        {
            "record_id": random.integers(0, 900, n).astype(str).astype(object),
            "tenant_name": pick("A", "B", "C", "X", "", None),
            "sku_name": pick("s1", "s2"),
            "usage_type": pick("compute", "storage"),
            "usage_unit": pick("DBU", "DBU", "GB", None),
            "region": pick("kr", "us", None),
            "node_type": pick("small", "large", None),
            "usage_date": pick("2023-12-31", "2024-01-01", "2024-01-31", None),
            "usage_quantity": pick(0.0, 1.0, 2.5, -1.0, None),
        }
    )
    hot = ["7", "A", "s1", "compute", "DBU", "kr", "small", "2024-01-01", 2.0]
    frame.iloc[: n // 3] = hot
    frame.loc[: n // 6, "record_id"] = [f"hot{i}" for i in range(n // 6 + 1)]
    frame.loc[random.integers(0, n, 50), "record_id"] = None
    price = pd.DataFrame(
        [("s1", "kr", "small", 0.5), ("s2", "us", "large", 0.25), ("s2", "kr", None, 9.0)],
        columns=["sku_name", "region", "node_type", "usd_per_dbu"],
    )

    keys = list(usage.USAGE_KEYS)
    good = frame[
        frame.record_id.notna()
        & (pd.to_numeric(frame.usage_quantity) >= 0)
        & frame.tenant_name.isin(["A", "B", "C"])
    ].assign(usage_quantity=lambda df: pd.to_numeric(df.usage_quantity))
    daily = (
        good.groupby(["usage_date", *keys], dropna=False)
        .agg(total=("usage_quantity", "sum"), records=("record_id", "nunique"))
        .reset_index()
    )
    daily = daily[(daily.usage_unit == "DBU") & (daily.total > 0) & daily.usage_date.notna()]
    daily["year"] = daily.usage_date.str[:4].astype(int)
    daily["month"] = daily.usage_date.str[5:7].astype(int)
    monthly = daily.groupby(["year", "month", *keys], dropna=False)[["total", "records"]].sum().reset_index()
    known = {tuple(p[:3]): p[3] for p in price.itertuples(index=False) if p.node_type}
    want = []
    for row in monthly.itertuples(index=False):
        plain = [None if pd.isna(v) else v for v in row]
        named = dict(zip(monthly.columns, plain))
        cost = named["total"] * known.get((named["sku_name"], named["region"], named["node_type"]), 0.0)
        want.append((*plain[:8], named["total"], cost, named["records"]))

    records = spark.createDataFrame(frame.astype(object).where(frame.notna(), None).values.tolist(), SCHEMA)
    prices = spark.createDataFrame(
        [tuple(p) for p in price.itertuples(index=False)],
        "sku_name string, region string, node_type string, usd_per_dbu double",
    )
    assert rows(medallion.monthly_billing(records, prices, ["A", "B", "C"])) == sorted(want, key=repr)
