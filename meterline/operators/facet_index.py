"""Counts of every facet value under a selection, from bitmaps and not from a scan of the monthly table.

Each non-null facet value has a bitmap over numbered rows, in buckets of 32,768 rows. A choice in one facet is the union of its values'
bitmaps, a selection the intersection over the facets. What choosing a value would show is the
intersection of its bitmap with the choices in all other facets, and the number of its bits. Rows are numbered along
a space-filling curve, so a value's rows lie in few buckets.

Defined results: NULL in a facet is never chosen, and is no value; repeated rows count each; values without a
row under the selection are shown with 0; an empty table has no values. Entries take 4 KB for each value and bucket
that has it, before compression.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.operators.clustered import clustered
from meterline.operators.facets import ALL, FACETS, Selection
from meterline.session import stored

_CURVE = ("tenant_name", "region", "usage_type", "month", "year")
_BITS = 4


@dataclass(frozen=True)
class FacetIndex:
    """``rows``: the facets of each row with its ``row_no``; ``entries``: ``facet, value, bucket, bits``."""

    rows: DataFrame
    entries: DataFrame


def build_facet_index(gold: DataFrame) -> FacetIndex:
    """Number the rows and store a bitmap for each facet value and bucket of rows."""
    facets = stored(gold.select(*FACETS), "facets-of-rows")
    laid_out = clustered(facets, _CURVE, bits=_BITS).withColumn("row_no", F.monotonically_increasing_id())
    rows = stored(laid_out, "numbered-rows")
    pairs = [F.struct(F.lit(name).alias("facet"), F.col(name).cast("string").alias("value")) for name in FACETS]
    unfolded = rows.select("row_no", F.explode(F.array(*pairs)).alias("pair")).select("row_no", "pair.*").filter("value IS NOT NULL")
    no = F.col("row_no")
    entries = unfolded.groupBy("facet", "value", F.bitmap_bucket_number(no).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(no)).alias("bits")
    )
    return FacetIndex(rows, stored(entries, "facet-entries"))


def _is_chosen(selection: Selection) -> Column:
    """Whether an entry's value is chosen in its facet."""
    chosen = F.lit(False)
    for facet in FACETS:
        values = getattr(selection, facet)
        named = F.lit(True) if ALL in values else F.col("value").isin([str(v) for v in values]) if values else F.lit(False)
        chosen = chosen | ((F.col("facet") == facet) & named)
    return chosen


def facet_counts(index: FacetIndex, selection: Selection = Selection()) -> DataFrame:
    """``facet, value, is_chosen, n_open, n_rows`` for every facet value.

    ``n_open`` counts its rows under the selection in the other facets, ``n_rows`` under the whole selection.
    Entries meet the choices by facet and bucket, so work is spread over the buckets whatever value is hot.
    """
    entries = index.entries.withColumn("is_chosen", _is_chosen(selection))
    choices = entries.filter("is_chosen").groupBy("facet", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    other = F.array(*[F.lit(name) for name in FACETS])
    to_others = choices.select(F.explode(F.array_remove(other, F.col("facet"))).alias("facet"), "bucket", "bits")
    masks = to_others.groupBy("facet", "bucket").agg(F.bitmap_and_agg("bits").alias("mask"), F.count(F.lit(1)).alias("n"))
    masks = masks.filter(F.col("n") == len(FACETS) - 1).drop("n")  # a facet without a choice in the bucket leaves none
    met = entries.join(masks, ["facet", "bucket"]).select("facet", "value", "bucket", F.explode(F.array("bits", "mask")).alias("bits"))
    shared = met.groupBy("facet", "value", "bucket").agg(F.bitmap_count(F.bitmap_and_agg("bits")).alias("n"))
    none = entries.select("facet", "value", "bucket", F.lit(0).cast("long").alias("n"))
    counts = shared.unionByName(none).groupBy("facet", "value").agg(F.sum("n").alias("n_open"))
    chosen = _is_chosen(selection)
    return counts.select("facet", "value", chosen.alias("is_chosen"), "n_open", F.when(chosen, F.col("n_open")).otherwise(0).alias("n_rows"))


def count_selected(index: FacetIndex, selection: Selection = Selection()) -> DataFrame:
    """Number of rows under the whole selection, as one row."""
    chosen = index.entries.filter(_is_chosen(selection))
    choices = chosen.groupBy("facet", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    met = choices.groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("n"))
    met = met.filter(F.col("n") == len(FACETS))
    return met.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).cast("long").alias("n_rows"))
