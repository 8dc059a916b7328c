"""Mergeable exact distinct counts: sets of record numbers per key, stored beside the daily totals.

Daily counts of distinct records cannot be added up to a longer period, since a record may come back
on another day. Here each record id gets a number once, and a key's records are kept as containers:
the numbers that share their upper bits, as a list of positions while they are few and as a bitmap
of 4 KB beyond that. Containers of any days and keys merge to those of a coarser key without the records, and
the counts are exact. Ids are numbered in the order of the first day and key that they occur with, so that the records of a
key are close together and fill few containers.

Defined results: a NULL id is no record; NULLs in keys are values of their own; a repeated record counts once;
no rows give no containers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.operators.usage import USAGE_KEYS
from meterline.session import stored

#: Positions that a container lists before it becomes a bitmap; both take 4 KB there.
MAX_LISTED = 1024
_NUMBERED_ROWS = 33  # lower bits of a number that count the rows of one task, as Spark's own numbering has it
_CONTENT = ("bucket", "positions", "bits", "n")


def number_records(
    records: DataFrame, known: DataFrame | None = None, order: Sequence[str] = ("usage_date", *USAGE_KEYS), record_id: str = "record_id"
) -> DataFrame:
    """A stored ``record_id, record_no`` row for each id, ``known`` ones included with the numbers they have.

    New ids are sorted by ranges over all tasks and numbered there; nothing is numbered in one place. They follow the known ones.
    """
    first = F.min(F.struct(*[F.col(f"`{name}`") for name in order])).alias("first")
    ids = records.select(F.col(f"`{record_id}`").alias("record_id"), *[F.col(f"`{name}`") for name in order])
    ids = ids.filter("record_id IS NOT NULL").groupBy("record_id").agg(first)
    base = 0
    if known is not None:
        ids = ids.join(known.select("record_id"), "record_id", "left_anti")
        last = known.agg(F.max("record_no")).first()[0]
        base = 0 if last is None else (last >> _NUMBERED_ROWS) + 1 << _NUMBERED_ROWS
    placed = stored(ids, "new-record-ids").repartitionByRange("first", "record_id").sortWithinPartitions("first", "record_id")
    numbered = stored(placed.select("record_id", (F.monotonically_increasing_id() + F.lit(base)).alias("record_no")), "record-numbers")
    return numbered if known is None else known.select("record_id", "record_no").unionByName(numbered)


def _keys(keys: Sequence[str]) -> list[Column]:
    return [F.col(f"`{key}`") for key in keys]


def _contained(single: DataFrame, whole: DataFrame | None, keys: Sequence[str], max_listed: int) -> DataFrame:
    """Containers made of ``(keys, bucket, position)`` rows, repeated or not, and of bitmaps ``(keys, bucket, bits)``.

    A bucket that holds a bitmap, or more than ``max_listed`` positions, becomes a bitmap; no list is longer than that.
    Positions are gathered once, in one shuffle: a bucket has at most 32,768 of them, however often they are repeated.
    """
    group = [*_keys(keys), F.col("bucket")]
    gathered = single.groupBy(*group).agg(F.sort_array(F.collect_set("position")).alias("positions"))
    gathered = stored(gathered, "record-positions")
    few = F.size("positions") <= max_listed
    lists, long = gathered.filter(few), gathered.filter(~few)
    if whole is not None:  # bitmaps are few, since each holds more positions than a list
        same = F.lit(True)
        for name in (*keys, "bucket"):
            same = same & F.col(f"s.`{name}`").eqNullSafe(F.col(f"w.`{name}`"))
        known = whole.select(*group).distinct().alias("w")
        long = long.unionByName(lists.alias("s").join(known, same, "left_semi"))
        lists = lists.alias("s").join(known, same, "left_anti")
    ones = long.select(*group, F.explode(F.col("positions").cast("array<long>")).alias("position"))
    made = ones.groupBy(*group).agg(F.bitmap_construct_agg("position").alias("bits"))
    if whole is not None:
        made = made.unionByName(whole.select(*group, "bits")).groupBy(*group).agg(F.bitmap_or_agg("bits").alias("bits"))
    bitmaps = stored(made, "record-bitmaps").select(
        *group, F.lit(None).cast("array<int>").alias("positions"), "bits", F.bitmap_count("bits").cast("long").alias("n")
    )
    lists = lists.select(*group, "positions", F.lit(None).cast("binary").alias("bits"), F.size("positions").cast("long").alias("n"))
    return bitmaps.unionByName(lists)


def record_sets(
    records: DataFrame, numbers: DataFrame, keys: Sequence[str] = ("usage_date", *USAGE_KEYS), record_id: str = "record_id", max_listed: int = MAX_LISTED
) -> DataFrame:
    """Containers ``(keys, bucket, positions, bits, n)`` of the records of each key."""
    held = records.select(*_keys(keys), F.col(f"`{record_id}`").alias("_record")).filter("_record IS NOT NULL")
    joined = held.join(numbers.select(F.col("record_id").alias("_record"), "record_no"), "_record")
    no = F.col("record_no")
    at = joined.select(*_keys(keys), F.bitmap_bucket_number(no).alias("bucket"), F.bitmap_bit_position(no).cast("int").alias("position"))
    return _contained(at, None, keys, max_listed)


def merge_record_sets(sets: DataFrame, keys: Sequence[str], max_listed: int = MAX_LISTED) -> DataFrame:
    """Containers of coarser keys, which are columns of ``sets`` such as a month made from the day.

    Listed positions are gathered by key and bucket, so a key with a third of all records is spread over all tasks;
    a bucket then holds at most ``max_listed`` positions or one bitmap.
    """
    listed = sets.filter("bits IS NULL").select(*_keys(keys), "bucket", F.explode("positions").alias("position"))
    return _contained(listed, sets.filter("bits IS NOT NULL").select(*_keys(keys), "bucket", "bits"), keys, max_listed)


def count_records(sets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exact number of distinct records per key from containers of any finer key; the records are not read.

    Listed positions that a bitmap of their bucket already holds are left out by a test of its bit.
    """
    group = [*_keys(keys), F.col("bucket")]
    whole = sets.filter("bits IS NOT NULL").groupBy(*group).agg(F.bitmap_or_agg("bits").alias("bits"))
    listed = sets.filter("bits IS NULL").select(*group, F.explode("positions").alias("position")).distinct()
    same = F.lit(True)
    for name in (*keys, "bucket"):
        same = same & F.col(f"l.`{name}`").eqNullSafe(F.col(f"w.`{name}`"))
    byte = F.expr("CAST(conv(hex(substring(w.bits, CAST(l.position DIV 8 AS INT) + 1, 1)), 16, 10) AS INT)")
    is_set = F.getbit(byte, F.col("l.position") % 8) == 1
    new = listed.alias("l").join(whole.alias("w"), same, "left").filter(F.col("w.bits").isNull() | ~is_set).select("l.*")
    counted = whole.select(*_keys(keys), F.bitmap_count("bits").cast("long").alias("n"))
    counted = counted.unionByName(new.select(*_keys(keys), F.lit(1).cast("long").alias("n")))
    return counted.groupBy(*_keys(keys)).agg(F.sum("n").alias("n_records"))
