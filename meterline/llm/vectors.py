"""Embedding near-dedup by counting collisions of one-dimensional projections.

Vectors are scaled to length one and projected on fixed random directions. A table consists of
a few directions whose signs make a bucket and one more along which the bucket is sorted; a pair
collides in a table if it shares the bucket and the later value lies in the window centred on
the earlier one. A pair that collides in at least ``MIN_COUNT`` of the tables is verified: its
cosine is computed in double precision from the vectors as given, scaled by powers of two.

How many collisions a pair has follows from its two vectors alone, so the table with the lowest
number in which it collides counts all of them on the spot, and no pair is written anywhere:
tasks return, for each vector, its number of links, and the components of the links. Buckets
larger than a block are multiplied block by block. Equal vectors are one row with a count.

Recall for a pair at the threshold is ``recall()``, computed from the angles; the constants give
over 0.97 at 0.93 and more above it.

Defined results: vectors that are null, empty or zero, or that hold null or non-finite
components, and rows without a label, link with nothing; vectors of different lengths do not
link; repeated rows link with each other; null ids come last among the members of a component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.llm.common import stored, table
from meterline.llm.components import components

COSINE = 0.93
TABLES, BITS = 28, 9
#: Half width of the window along the sorted direction, in multiples of its spread for a pair at
#: the threshold.
WINDOW = 2.0
MIN_COUNT = 2
#: Vectors of a bucket that are compared at a time, and that one task holds.
BLOCK, TASK_ROWS = 1024, 4096
SEED = 20240607


def directions(dimension: int) -> np.ndarray:
    """TABLES x (BITS + 1) directions, the same on every machine."""
    return np.random.default_rng(SEED + dimension).standard_normal((TABLES * (BITS + 1), dimension))


def recall(cosine: float = COSINE) -> float:
    """Chance that a pair of this cosine collides in MIN_COUNT tables or more."""
    same_sign = 1 - math.acos(cosine) / math.pi
    spread = math.sqrt(2 - 2 * cosine)
    p = same_sign**BITS * math.erf(WINDOW * math.sqrt(2 - 2 * COSINE) / spread / math.sqrt(2))
    return 1 - sum(math.comb(TABLES, k) * p**k * (1 - p) ** (TABLES - k) for k in range(MIN_COUNT))


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """The vectors (rows) in double precision, each divided by the power of two next above its largest
    component: exact, and no square overflows or vanishes."""
    vectors = vectors.astype(np.float64)
    _, power = np.frexp(np.abs(vectors).max(axis=1, keepdims=True))
    return np.ldexp(vectors, -power)


def _projected(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and value of each vector (rows) in each table."""
    vectors = _scaled(vectors)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    values = (unit @ directions(vectors.shape[1]).T).reshape(len(vectors), TABLES, BITS + 1)
    bucket = (values[:, :, :BITS] > 0) @ (1 << np.arange(BITS))
    return bucket.astype(np.int32), values[:, :, BITS]


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each vector and table."""
    names = ["label", "dimension", "tab", "bucket", "vector_id", "copies", "embedding"]
    for batch in batches:
        lists = batch.column(3)
        sizes = np.diff(lists.offsets.to_numpy())
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            part = lists.take(pa.array(rows))
            vectors = part.flatten().to_numpy().reshape(-1, size)
            step = max(1, (1 << 20) // (TABLES * int(size)))
            for at in range(0, len(rows), step):
                bucket, _ = _projected(vectors[at : at + step])
                n = len(bucket)
                take = pa.array(np.repeat(np.arange(at, at + n), TABLES))
                fixed = [batch.column(i).take(pa.array(rows)).take(take) for i in range(3)]
                columns = [fixed[1]]
                columns += [pa.array(np.full(n * TABLES, size, np.int32))]
                columns += [pa.array(np.tile(np.arange(TABLES, dtype=np.int32), n)), pa.array(bucket.ravel())]
                columns += [fixed[0], fixed[2], part.take(take)]
                yield pa.RecordBatch.from_arrays(columns, names)


def _pairs(tab: int, buckets, values, at, rows, others, window: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, other) that collide in this table and in none before it, often enough."""
    near = np.abs(at[rows][:, None] - at[others][None, :]) <= window
    near &= rows[:, None] < others[None, :]
    a, b = np.nonzero(near)
    a, b = rows[a], others[b]
    count = np.ones(len(a), np.int64)
    for t in range(TABLES):
        if t == tab:
            continue
        hit = (buckets[a, t] == buckets[b, t]) & (np.abs(values[a, t] - values[b, t]) <= window)
        if t < tab:
            a, b, count = a[~hit], b[~hit], count[~hit]
        else:
            count += hit
    enough = count >= MIN_COUNT
    return a[enough], b[enough]


def _cell(tab: int, ids: np.ndarray, many: np.ndarray, vectors: np.ndarray, side: np.ndarray, cosine: float):
    """Links of each vector of some buckets, counted with copies, and the edges of a spanning forest.

    Where the vectors are of two sides, only pairs between the sides count.
    """
    two_sides = side.min() != side.max()
    vectors = _scaled(vectors)
    buckets, values = _projected(vectors)
    window = WINDOW * math.sqrt(2 - 2 * cosine)
    gap = 2 * (np.abs(values[:, tab]).max() + window)  # buckets lie apart on one line
    at = values[:, tab] + gap * buckets[:, tab]
    order = np.argsort(at, kind="stable")
    at = at[order]
    buckets, values, vectors = buckets[order], values[order], vectors[order]
    ids, many, side = ids[order], many[order], side[order]
    norms = np.linalg.norm(vectors, axis=1)
    degree, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
    edges = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for begin in range(0, len(ids), BLOCK):
        rows = np.arange(begin, min(begin + BLOCK, len(ids)))
        last = int(np.searchsorted(at, at[rows[-1]] + window, "right"))
        for first in range(begin, last, BLOCK):
            others = np.arange(first, min(first + BLOCK, last))
            a, b = _pairs(tab, buckets, values, at, rows, others, window)
            if two_sides:
                between = side[a] != side[b]
                a, b = a[between], b[between]
            linked = np.einsum("ij,ij->i", vectors[a], vectors[b]) / (norms[a] * norms[b]) >= cosine
            a, b = a[linked], b[linked]
            np.add.at(degree, a, many[b])
            np.add.at(degree, b, many[a])
            for i, j in zip(a.tolist(), b.tolist(), strict=True):
                x, y = find(i), find(j)
                if x != y:
                    root[max(x, y)] = min(x, y)
                    edges.append((ids[i], ids[j]))
    hit = np.flatnonzero(degree)
    return ids[hit], degree[hit], edges


FOUND = "a bigint, b bigint, links bigint"


def _links(cosine: float):
    """Links within cells, whose rows follow one another; rows (a, null, links) and (a, b, null).

    Small buckets of a table are handled together.
    """

    def rows_of(key, held: list) -> list[tuple]:
        if len(held) < 2:
            return []
        ids = np.array([h[0] for h in held])
        many = np.array([h[1] for h in held])
        vectors, side = np.array([h[2] for h in held], np.float64), np.array([h[3] for h in held])
        if key[4] != key[5] and side.min() == side.max():
            return []
        found, degree, edges = _cell(key[2], ids, many, vectors, side, cosine)
        out = [(int(i), None, int(n)) for i, n in zip(found, degree, strict=True)]
        return out + [(int(i), int(j), None) for i, j in edges]

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([f[i] for f in found], pa.int64()) for i in range(3)]
        return pa.RecordBatch.from_arrays(columns, ["a", "b", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            found = []
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True))
            ids, copies, sides, blocks = (batch.column(i).to_pylist() for i in (6, 7, 9, 10))
            offsets = batch.column(8).offsets.to_numpy()
            vectors = np.split(batch.column(8).flatten().to_numpy(), offsets[1:-1] - offsets[0])
            for at, *row in zip(keys, ids, copies, vectors, sides, blocks, strict=True):
                together = key and at[:3] == key[:3] and row[4] == held[-1][4] == 1 and len(held) < TASK_ROWS
                if at != key:
                    if not together:
                        found += rows_of(key, held)
                        held = []
                    key = at
                held.append(row)
            yield batch_of(found)
        yield batch_of(rows_of(key, held))

    return run


def near_vectors(
    rows: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label"
) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` for each row."""
    given = F.col(f"`{embedding}`")
    vector = given.cast("array<double>")
    element = rows.schema[embedding].dataType.elementType.simpleString()
    zero = F.lit(0).cast(element)
    usable = F.coalesce(
        F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
        & F.exists(vector, lambda x: x != 0)
        & F.col(f"`{label}`").isNotNull(),
        F.lit(False),
    )
    read = rows.select(
        F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{label}`").alias("label"),
        F.when(usable, F.transform(given, lambda x: x + zero)).alias("embedding"),  # -0 becomes 0
    )
    key = lambda seed: F.xxhash64(F.lit(seed), "label", F.to_json(F.struct("embedding"))).alias(f"key_{seed}")
    read = stored(read.select("*", key(1), key(2)), "vectors")
    # One row for each label and vector, however many copies there are.
    distinct = read.filter("embedding is not null").groupBy("label", "key_1", "key_2", "embedding")
    distinct = distinct.agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    # A number of its own tells a vector from all others; the two keys only lead the rows back to it.
    distinct = stored(distinct.withColumn("vector_id", F.monotonically_increasing_id()), "vectors-distinct")
    numbered = distinct.select("vector_id", "label", "copies", "embedding")
    kind = numbered.schema["label"].dataType.simpleString()
    schema = f"label {kind}, dimension int, tab int, bucket int, vector_id bigint, copies bigint, embedding array<{element}>"
    spread = numbered.mapInArrow(_spread, schema)
    cell = ["label", "dimension", "tab", "bucket"]
    # Buckets too large for a task are dealt into blocks; each pair of blocks is a cell.
    large = spread.groupBy(*cell).agg(F.count("*").alias("rows")).filter(F.col("rows") > TASK_ROWS)
    large = stored(large.select(*cell, F.ceil(F.col("rows") / (TASK_ROWS // 2)).alias("blocks")), "vector-buckets")
    placed = spread.join(large, cell, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("side", F.pmod("vector_id", "blocks"))
    placed = placed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    cell += ["row", "column"]
    placed = placed.withColumns({"row": F.least("side", "other"), "column": F.greatest("side", "other")})
    spread = placed.select(*cell, "vector_id", "copies", "embedding", "side", "blocks")
    spread = spread.repartition(*cell).sortWithinPartitions(*cell)
    found = stored(spread.mapInArrow(_links(cosine), FOUND), "vector-links")
    degree = found.filter("links is not null").groupBy(F.col("a").alias("vector_id")).agg(F.sum("links").alias("links"))
    joined = components(found.filter("b is not null").select("a", "b"))
    groups = (
        distinct.select("vector_id", "key_1", "key_2", "copies", "least")
        .join(joined.withColumnRenamed("node", "vector_id"), "vector_id", "left")
        .withColumn("component", F.coalesce("component", "vector_id"))
    )
    least = groups.groupBy("component").agg(F.min("least").alias("component_id"))
    groups = groups.join(least, "component").join(degree, "vector_id", "left").select(
        "key_1", "key_2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    alone = F.col("embedding").isNull()
    result = read.join(groups, ["key_1", "key_2"], "left").select(
        "vec_id",
        F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return result.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op10_near_vectors(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
