"""Facets and measures on literal rows."""

import pytest

from meterline.operators import measures
from meterline.operators.facets import ALL, Selection, facet_filter, facet_values
from meterline.plans.dashboard import dashboard

SCHEMA = (
    "year int, month int, tenant_name string, sku_name string, usage_type string, usage_unit string, "
    "region string, node_type string, monthly_dbu double, est_cost_usd double, monthly_records long"
)


def row(year=2024, month=1, tenant="A", region="kr", kind="compute", cost=1.0):
    return (year, month, tenant, "sku", kind, "DBU", region, "small", 1.0, cost, 1)


@pytest.fixture
def gold(spark):
    return lambda *given: spark.createDataFrame(list(given), SCHEMA)


def test_all_hides_null_values(gold):
    df = gold(row(), row(region=None), row(tenant=None), row(kind=None))
    assert facet_filter(df).count() == 1


def test_all_beside_other_values_means_all(gold):
    df = gold(row(tenant="A"), row(tenant="B"))
    assert facet_filter(df, Selection(tenant_name=[ALL, "A"])).count() == 2


def test_selections_are_combined(gold):
    df = gold(row(month=1), row(month=2), row(month=2, region="us"), row(year=2023, month=2))
    chosen = Selection(year=[2024], month=[2], region=["kr", "jp"])
    assert facet_filter(df, chosen).count() == 1


@pytest.mark.parametrize("facet", ["tenant_name", "year", "month", "region", "usage_type"])
def test_empty_selection_gives_no_rows(gold, facet):
    assert facet_filter(gold(row()), Selection(**{facet: []})).count() == 0


def test_facet_values_are_sorted_numbers_as_numbers(gold):
    df = gold(row(month=10), row(month=2), row(month=2, tenant=None), row(tenant="0"))
    values = [tuple(r) for r in facet_values(df).collect()]
    assert [v for f, v in values if f == "month"] == ["1", "2", "10"]
    assert [v for f, v in values if f == "tenant_name"] == ["0", "A"]


def test_kpis_of_no_rows_are_zero(gold):
    kpis = dashboard(gold(row()), Selection(region=["none"]))["kpis"]
    assert [tuple(r) for r in kpis.collect()] == [(0.0, 0.0, 0)]
    assert measures.total_cost(gold()).first().total_cost == 0.0
    assert measures.recent_row_cost(gold()).first().recent_cost == 0.0
    assert measures.last_period_cost(gold()).first().last_period_cost == 0.0


def test_recent_cost_is_one_row_of_the_latest_month(gold):
    df = gold(row(2023, 12, cost=50.0), row(2024, 2, "A", cost=3.0), row(2024, 2, "B", cost=4.0), row(2024, 1, cost=9.0))
    assert measures.recent_row_cost(df).first().recent_cost in (3.0, 4.0)
    assert measures.last_period_cost(df).first().last_period_cost == 7.0
    kpis = measures.kpi_row(df).first()
    assert (kpis.total_cost, kpis.active_tenants) == (66.0, 2)
    assert kpis.recent_cost == measures.recent_row_cost(df).first().recent_cost


def test_null_tenants_and_costs(gold):
    df = gold(row(tenant=None, cost=5.0), row(tenant="A", cost=None), row(tenant="B", cost=2.0))
    assert measures.active_tenants(df).first()[0] == 2
    assert measures.active_tenants(df, approximate=True).first()[0] == 2
    assert measures.kpi_row(df).first().total_cost == 7.0
    assert {tuple(r) for r in measures.cost_by_tenant(df).collect()} == {("A", 0.0), ("B", 2.0)}


def test_ranking_and_details_are_ordered(gold):
    df = gold(row(cost=1.0, tenant="A"), row(cost=3.0, tenant="B"), row(cost=3.0, tenant="C", month=2))
    ranked = [r.tenant_name for r in measures.top_tenants(df).collect()]
    assert ranked == ["B", "C", "A"]
    assert [r.tenant_name for r in measures.top_tenants(df, 1).collect()] == ["B"]
    assert [(r.month, r.tenant_name) for r in measures.detail_rows(df).collect()] == [(1, "A"), (1, "B"), (2, "C")]
    assert measures.preview(df, 2).count() == 2
