"""Row constraints: named predicates that drop rows or only count violations."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from typing import Literal

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Constraint:
    """A row holds when the predicate is TRUE; FALSE and NULL both violate it."""

    name: str
    predicate: str | Column
    action: Literal["drop", "warn"] = "drop"

    def holds(self) -> Column:
        given = self.predicate
        return F.expr(given) if isinstance(given, str) else given

    def violated(self) -> Column:
        return ~F.coalesce(self.holds(), F.lit(False))


def expect(name: str, predicate: str | Column) -> Constraint:
    return Constraint(name, predicate, "warn")


def expect_or_drop(name: str, predicate: str | Column) -> Constraint:
    return Constraint(name, predicate, "drop")


def enforce(df: DataFrame, constraints: Iterable[Constraint]) -> DataFrame:
    """Keep the rows that hold every dropping constraint.

    Plain filters, so that Catalyst moves them below aggregates and into the scan.
    """
    for constraint in constraints:
        if constraint.action == "drop":
            df = df.filter(constraint.holds())
    return df


def enforce_observed(
    df: DataFrame, constraints: Iterable[Constraint], metric_name: str
) -> tuple[DataFrame, Observation]:
    """As ``enforce``, with row and violation counts collected during the same pass.

    The counts come with the first action on the result. An observed plan keeps its
    filters above the observation, so use this only where the counts are wanted.
    """
    constraints = list(constraints)
    observation = Observation(metric_name)
    counts = [F.count_if(c.violated()).alias(c.name) for c in constraints]
    observed = df.observe(observation, F.count(F.lit(1)).alias("n_rows"), *counts)
    return enforce(observed, constraints), observation


def violations(df: DataFrame, constraints: Iterable[Constraint]) -> DataFrame:
    """One row per constraint: ``constraint, action, n_rows, n_failed``; one pass over ``df``."""
    constraints = list(constraints)
    totals = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(c.violated()).alias(f"failed_{i}") for i, c in enumerate(constraints)],
    )
    report = F.array(
        *[
            F.struct(
                F.lit(c.name).alias("constraint"),
                F.lit(c.action).alias("action"),
                F.col("n_rows"),
                F.col(f"failed_{i}").alias("n_failed"),
            )
            for i, c in enumerate(constraints)
        ]
    )
    return totals.select(F.inline(report))
