"""A layout of the monthly table in which files and row groups are narrow in several columns at once.

Rows are sorted along a space-filling curve: each column's value is placed among a few split values, and the
bits of these places are interleaved, so that rows near each other on the curve are near in all columns. The
statistics that Parquet keeps per row group then let a scan skip most of the table for a filter on any of the columns,
where a plain sort helps its first column only. The place on the curve is an expression of built-in functions.

Defined results: rows and columns are those given, order aside; NULLs sort before all values; repeated
rows stay; a column with one value, or an empty table, has no split values and takes no bits.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CURVE_COLUMNS = ("tenant_name", "region", "usage_type")
#: Bits of a column's place on the curve, and how many distinct values its split values are taken from.
BITS, MAX_VALUES = 5, 4096


def split_values(rows: DataFrame, columns: Sequence[str] = CURVE_COLUMNS, bits: int = BITS, max_values: int = MAX_VALUES) -> dict[str, list]:
    """At most ``2^bits - 1`` values per column that cut its distinct values into even parts.

    They come from ``max_values`` distinct values at most, those of the smallest hashes. Only how well rows
    cluster depends on them.
    """
    if not 1 <= bits * len(columns) <= 62:
        raise ValueError("the places of all columns must fit into 62 bits")
    cuts, most = {}, 2**bits - 1
    for name in columns:
        values = rows.select(F.col(f"`{name}`").alias("value")).filter("value IS NOT NULL").distinct()
        found = sorted(r.value for r in values.orderBy(F.xxhash64("value"), "value").limit(max_values).collect())
        step = max(1.0, len(found) / (most + 1))
        cuts[name] = [found[int(i * step)] for i in range(1, most + 1) if int(i * step) < len(found)]
    return cuts


def _reached_by(name: str):
    return lambda cut: cut <= F.col(f"`{name}`")


def curve_place(cuts: Mapping[str, Sequence], bits: int = BITS) -> Column:
    """The place on the curve, from the split values of each column."""
    places = []
    for name, values in cuts.items():
        if values:
            rank = F.size(F.filter(F.array(*[F.lit(v) for v in values]), _reached_by(name)))
            places.append(F.floor(rank * 2**bits / (len(values) + 1)).cast("long"))
    turns = [
        F.shiftleft(F.shiftright(place, bit).bitwiseAND(F.lit(1)), bit * len(places) + number)
        for bit in range(bits)
        for number, place in enumerate(places)
    ]
    return reduce(lambda a, b: a.bitwiseOR(b), turns, F.lit(0).cast("long"))


def clustered(rows: DataFrame, columns: Sequence[str] = CURVE_COLUMNS, files: int | None = None, bits: int = BITS) -> DataFrame:
    """The rows in ranges of the curve, sorted within each.

    Rows of one place are told apart by all their columns that can be sorted, so a tenant with a third of all rows is cut
    into several ranges. ``files`` is the number of ranges, by default as many as shuffle partitions.
    """
    place = curve_place(split_values(rows, columns, bits), bits)
    rest = [f"`{f.name}`" for f in rows.schema.fields if f.dataType.typeName() not in ("map", "variant", "array", "struct")]
    keys = [place, *[F.col(name) for name in rest]]
    ranged = rows.repartitionByRange(files, *keys) if files else rows.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*keys)


def write_clustered(
    rows: DataFrame, path: str, columns: Sequence[str] = CURVE_COLUMNS, files: int | None = None, bits: int = BITS, row_group_bytes: int = 32 << 20
) -> DataFrame:
    """The rows stored along the curve as Parquet, and read back; filters on the columns skip row groups."""
    layout = clustered(rows, columns, files, bits)
    layout.write.option("parquet.block.size", str(row_group_bytes)).mode("errorifexists").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
