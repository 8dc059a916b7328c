"""What a billing dashboard shows, from one filtered table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from meterline.operators import measures
from meterline.operators.facets import Selection, cast_period, facet_filter, facet_values


def dashboard(gold: DataFrame, selection: Selection = Selection()) -> dict[str, DataFrame]:
    """The frames of a dashboard; each is lazy and filters down to the scan."""
    whole = cast_period(gold)
    rows = facet_filter(whole, selection)
    return {
        "facets": facet_values(whole),
        "kpis": measures.kpi_row(rows),
        "cost_by_tenant": measures.top_tenants(rows),
        "details": measures.detail_rows(rows),
    }
