"""Rows that break rules as a table of their own, and the history of how many did.

One pass writes all rows of a stage, those kept and those rejected, as partitions of one table;
each row carries the names of the rules that it breaks. Counts are taken from what is stored and
not from counters of tasks, which count a task twice that ran twice.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.operators.constraints import Constraint
from meterline.sinks import materialize, replace_partitions

#: Columns that a judged table has besides its own.
REJECTED, BROKEN = "rejected", "broken_rules"
HISTORY = "refresh_id string, stage string, constraint string, action string, n_rows bigint, n_failed bigint"


def broken_rules(constraints: Iterable[Constraint]) -> Column:
    """Names of the rules that a row breaks, in their order."""
    named = [F.when(c.violated(), F.lit(c.name)) for c in constraints]
    return F.array_compact(F.array(*named)) if named else F.array().cast("array<string>")


def judged(rows: DataFrame, constraints: Iterable[Constraint]) -> DataFrame:
    """All rows with ``broken_rules``, and ``rejected`` if one of them drops the row; one pass, no shuffle."""
    constraints = list(constraints)
    if clash := {REJECTED, BROKEN} & set(rows.columns):
        raise ValueError(f"the rows have columns {sorted(clash)} already")
    dropping = F.lit(False)
    for c in constraints:
        if c.action == "drop":
            dropping = dropping | c.violated()
    return rows.withColumns({BROKEN: broken_rules(constraints), REJECTED: dropping})


@dataclass(frozen=True)
class Split:
    """The kept rows with their own columns, the rejected ones with ``broken_rules``, and all as stored."""

    kept: DataFrame
    rejected: DataFrame
    judged: DataFrame


def store_split(rows: DataFrame, constraints: Iterable[Constraint], table: str, comment: str | None = None) -> Split:
    """Judge and store the rows in one pass; kept and rejected rows are partitions that readers prune."""
    materialize(judged(rows, constraints), table, comment, partition_by=(REJECTED,))
    return open_split(rows.sparkSession, table)


def open_split(spark: SparkSession, table: str) -> Split:
    stored = spark.read.table(table)
    own = [f"`{c}`" for c in stored.columns if c not in (REJECTED, BROKEN)]
    kept = stored.filter(~F.col(REJECTED)).select(*own)
    return Split(kept, stored.filter(REJECTED).select(*own, BROKEN), stored)


def rule_counts(split: Split, constraints: Iterable[Constraint], stage: str, refresh_id: str) -> DataFrame:
    """One row for each rule: how many stored rows there are, and how many break it.

    Only the two judging columns are read. A row that breaks several rules counts for each.
    """
    constraints = list(constraints)
    totals = split.judged.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(F.array_contains(BROKEN, c.name)).alias(f"failed_{i}") for i, c in enumerate(constraints)],
    )
    rules = [
        F.struct(
            F.lit(refresh_id).alias("refresh_id"),
            F.lit(stage).alias("stage"),
            F.lit(c.name).alias("constraint"),
            F.lit(c.action).alias("action"),
            F.col("n_rows"),
            F.col(f"failed_{i}").alias("n_failed"),
        )
        for i, c in enumerate(constraints)
    ]
    return totals.select(F.inline(F.array(*rules)))


def record_history(counts: DataFrame, table: str) -> DataFrame:
    """Add the counts of a refresh to the stored history; recording the same refresh and stage again replaces them."""
    spark = counts.sparkSession
    rows = counts.select("constraint", "action", "n_rows", "n_failed", "refresh_id", "stage")
    if not spark.catalog.tableExists(table):
        return materialize(rows, table, "Rows and violations of each rule by refresh.", partition_by=("refresh_id", "stage"))
    return replace_partitions(rows, table)
