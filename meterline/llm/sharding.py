"""Sharding by a permutation-filled lookup table, with DataFrame functions only.

Each shard has its own order of preference over the slots of a table of prime size: slots
offset, offset + skip, ... modulo the size. The shards take turns, each claiming its first
preferred slot that is free, until the table is full, so shards differ by one slot at most,
and a shard that comes or goes moves few slots of the others. The table is a small constant
whose size is a parameter; it is broadcast, and a row finds its shard by its key's slot.

Defined results: a null key is placed by ``spread`` (such as the text), so that rows without a
key do not meet in one shard; equal keys share a shard; an empty table gives no rows; columns
``slot`` and ``shard`` of the rows stay, and the results are then called ``slot_1`` and ``shard_1``,
or by the next free number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.llm.common import free_name, table

SHARDS = 32
#: A prime, above a hundred times the number of shards.
TABLE_SIZE = 4099


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def lookup_table(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """The number of the shard that owns each slot; ``size`` must be prime and at least the shards."""
    if not shards or size < len(shards) or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("a prime number of slots, at least one for each shard, is needed")
    at = [_hash(f"{name}:offset") % size for name in shards]
    skip = [_hash(f"{name}:skip") % (size - 1) + 1 for name in shards]
    owner = [-1] * size
    for turn in range(size):
        shard = turn % len(shards)
        while owner[at[shard]] >= 0:
            at[shard] = (at[shard] + skip[shard]) % size
        owner[at[shard]] = shard
    return owner


def slot_of(key: Column, size: int = TABLE_SIZE, spread: Column | None = None) -> Column:
    text = key.cast("string")
    if spread is not None:
        text = F.coalesce(text, spread.cast("string"))
    digits = F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 15)
    return F.conv(digits, 16, 10).cast("long") % size


def _table(spark: SparkSession, shards: Sequence[str], size: int) -> DataFrame:
    owners = ",".join(map(str, lookup_table(shards, size)))
    listed = F.split(F.lit(owners), ",").cast("array<int>")
    return spark.range(1).select(F.posexplode(listed).alias("slot", "shard"))


def place(rows: DataFrame, key: str, shards: Sequence[str], size: int = TABLE_SIZE, spread: str | None = None) -> DataFrame:
    """The rows with their ``slot`` and ``shard`` number as the last columns; neither shuffled nor sorted."""
    spread_by = F.col(f"`{spread}`") if spread else None
    slot, shard = free_name(rows.columns, "slot"), free_name(rows.columns, "shard")
    slots = _table(rows.sparkSession, shards, size).select(F.col("slot").cast("long").alias(slot), F.col("shard").alias(shard))
    placed = rows.withColumn(slot, slot_of(F.col(f"`{key}`"), size, spread_by))
    joined = placed.join(F.broadcast(slots), slot)  # as many rows as the table's size
    return joined.select(*[f"`{name}`" for name in (*rows.columns, slot, shard)])


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    placed = place(docs, "doc_id", [f"shard-{i}" for i in range(SHARDS)], spread="text")
    return placed.select("doc_id", "slot", "shard")


OP8_SQL = f"""
WITH RECURSIVE shards AS (
    SELECT i::BIGINT AS i, ('0x' || substr(md5('shard-' || i || ':offset'), 1, 8))::BIGINT % {TABLE_SIZE} AS begin_at,
           ('0x' || substr(md5('shard-' || i || ':skip'), 1, 8))::BIGINT % {TABLE_SIZE - 1} + 1 AS skip
    FROM range({SHARDS}) t(i)
), fill(turn, slot, free) AS (
    SELECT -1::BIGINT, NULL::BIGINT, repeat('1', {TABLE_SIZE})::BIT
    UNION ALL
    SELECT turn + 1, found, set_bit(free, found::INTEGER, 0)
    FROM (
        SELECT turn, free, list_filter(
            list_transform(range({TABLE_SIZE}), lambda j: (begin_at + j * skip) % {TABLE_SIZE}),
            lambda s: get_bit(free, s::INTEGER) = 1)[1] AS found
        FROM fill JOIN shards ON i = (turn + 1) % {SHARDS} WHERE turn + 1 < {TABLE_SIZE}
    )
)
SELECT doc_id, k.slot, (turn % {SHARDS})::INTEGER AS shard
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 15))::BIGINT % {TABLE_SIZE} AS slot
      FROM documents) k
JOIN fill USING (slot)
"""
