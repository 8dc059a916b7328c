"""Facet values and facet filters over the monthly table."""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the selection that stands for every non-null value.
ALL = "(All)"
FACETS = ("tenant_name", "year", "month", "region", "usage_type")


@dataclass(frozen=True)
class Selection:
    """Chosen values per facet; a field left out selects every non-null value."""

    tenant_name: Collection = (ALL,)
    year: Collection = (ALL,)
    month: Collection = (ALL,)
    region: Collection = (ALL,)
    usage_type: Collection = (ALL,)

    def condition(self) -> Column:
        terms = [_chosen(facet, getattr(self, facet)) for facet in FACETS]
        whole = terms[0]
        for term in terms[1:]:
            whole = whole & term
        return whole


def _chosen(facet: str, values: Collection) -> Column:
    column = F.col(facet)
    if ALL in values:
        return column.isNotNull()
    return column.isin(list(values)) if values else F.lit(False)


def cast_period(gold: DataFrame) -> DataFrame:
    return gold.withColumns({name: F.col(name).cast("int") for name in ("year", "month")})


def facet_filter(gold: DataFrame, selection: Selection = Selection()) -> DataFrame:
    """Rows chosen in all five facets; NULL in a facet is never chosen."""
    return gold.filter(selection.condition())


def facet_values(gold: DataFrame) -> DataFrame:
    """Sorted distinct non-null values of every facet, as ``facet, value`` rows.

    One pass: the five values of a row are unfolded and made distinct before the shuffle.
    """
    unfolded = gold.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(name).alias("facet"), F.col(name).cast("string").alias("value"))
                    for name in FACETS
                ]
            )
        ).alias("entry")
    ).select("entry.*")
    is_number = F.col("facet").isin("year", "month")
    return (
        unfolded.filter("value IS NOT NULL")
        .distinct()
        .orderBy("facet", F.when(is_number, F.expr("try_cast(value AS INT)")), "value")
    )
