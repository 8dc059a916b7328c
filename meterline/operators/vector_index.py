"""Exact nearest chunks from a stored index: clusters with radii, visited while a bound allows it.

The index is two tables of files. ``members`` has every chunk once, in the partition of the
cluster whose centre is nearest to it; ``clusters`` has the centres and how far their members
reach. The angle between a question and a chunk is at least the angle to the cluster's centre
less the cluster's radius, which bounds the score of all its members. Questions visit clusters
by falling bound, some at a time, until their k-th score is above the bounds of all others.
So the hits are those of a search over all chunks, and most chunks are never scored if the
vectors form clusters; if they do not, everything is scored.

Centres are fitted on a sample of bounded size (``SAMPLE_ENTRIES``); all chunks are indexed.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Literal

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from meterline.operators.vectors import (
    GRID_CHUNK_ENTRIES,
    GRID_QUESTION_ENTRIES,
    SCORE_DIGITS,
    _ids,
    _matrix,
    _result,
    _Scan,
    _size,
    _usable,
)
from meterline.session import stored

# The task functions below travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Entries of all centres together, which are sent to every task (32 MB as doubles).
CENTRE_ENTRIES = 4_000_000
#: Entries of the vectors that centres are fitted on, about.
SAMPLE_ENTRIES = 64_000_000
ITERATIONS = 10
#: Clusters that a question visits in each round; the last one takes all that may still hold a hit.
STEPS = (1, 16, None)
#: Bits of questions and clusters that a task unpacks at a time.
BLOCK_BITS = 8_000_000
#: Room for rounding, in radians and in scores.
SLACK = 1e-7
#: The cluster of zero vectors, whose score is 0 for every question.
ZERO = -1
_CLUSTERS = "cluster int, centre array<double>, least double, n bigint"


@dataclass(frozen=True)
class VectorIndex:
    """Tables of an index: ``cluster, chunk id, vector, near`` and ``cluster, centre, least, n``.

    ``near`` is the cosine of a member and its centre, ``least`` the least of them.
    """

    members: DataFrame
    clusters: DataFrame
    chunk_id: str


@dataclass(frozen=True)
class Found:
    """Hits, and ``round, n_questions, n_scored, n_all`` of each round: pairs scored, and all pairs there are."""

    hits: DataFrame
    report: DataFrame


def build_index(
    chunks: DataFrame,
    path: str,
    n_clusters: int | None = None,
    chunk_id: str = "chunk_id",
    vector: str = "embedding",
    on_bad_vector: Literal["raise", "drop"] = "raise",
    seed: int = 1,
) -> VectorIndex:
    """Index all chunks below a new path; two clusters or more, by default about the square root of their number."""
    spark = chunks.sparkSession
    given = _usable(chunks, chunk_id, vector, on_bad_vector)
    count, longest = _size(given)
    most = max(1, CENTRE_ENTRIES // longest)
    k = max(2, min(n_clusters or math.isqrt(max(0, count - 1)) + 1, most))
    not_zero = F.exists("vector", lambda x: x != 0)
    # A hash of the id decides, so that a rerun samples the same rows.
    parts = 1_000_000
    share = min(parts, math.ceil(parts * SAMPLE_ENTRIES / max(1, count * longest)))
    # Entries are scaled by the largest one first, so that no square overflows.
    largest = F.array_max(F.transform("vector", F.abs))
    scaled = F.transform("vector", lambda x: x / F.col("largest"))
    sample = given.filter(not_zero & (F.pmod(F.xxhash64(chunk_id), F.lit(parts)) < share))
    points = sample.withColumn("largest", largest).select(array_to_vector(scaled).alias("features"))
    points = stored(points, "index-sample")
    centres = np.zeros((0, longest))
    if not points.isEmpty():
        means = KMeans(k=k, distanceMeasure="cosine", seed=seed, maxIter=ITERATIONS)
        centres = np.array(means.fit(points).clusterCenters())
        centres = centres / np.linalg.norm(centres, axis=1, keepdims=True)
    _write(given, centres, path, chunk_id)
    return open_index(spark, path, chunk_id)


def open_index(spark: SparkSession, path: str, chunk_id: str = "chunk_id") -> VectorIndex:
    """An index that is stored below the path."""
    rows = spark.read.schema(_CLUSTERS).parquet(f"{path}/clusters")
    clusters = rows.groupBy("cluster").agg(
        F.first("centre").alias("centre"), F.min("least").alias("least"), F.sum("n").alias("n")
    )
    columns = spark.read.parquet(f"{path}/columns").schema  # an index may have no member
    return VectorIndex(spark.read.schema(columns).parquet(f"{path}/members"), clusters, chunk_id)


def extend_index(
    index: VectorIndex, path: str, chunks: DataFrame, vector: str = "embedding", on_bad_vector: Literal["raise", "drop"] = "raise"
) -> VectorIndex:
    """Add chunks whose ids are new to the clusters that are there. Radii grow as needed, centres stay.

    The reach of clusters is stored before their members, so an extension that fails between leaves
    bounds that are too wide and never too narrow; repeat it then.
    """
    held = index.clusters.filter(F.col("cluster") != ZERO).orderBy("cluster").toArrow()  # as many as centres
    centres = held.column("centre").combine_chunks()
    centres = centres.flatten().to_numpy().reshape(len(held), -1) if len(held) else np.zeros((0, 1))
    _write(_usable(chunks, index.chunk_id, vector, on_bad_vector), centres, path, index.chunk_id)
    return open_index(chunks.sparkSession, path, index.chunk_id)


def _write(given: DataFrame, centres: np.ndarray, path: str, chunk_id: str) -> None:
    spark = given.sparkSession
    shared = spark.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for batch in batches:
            if not len(batch):
                continue
            ids, vectors = batch.column(0), batch.column(1)
            unit = _matrix(ids, vectors, centres.shape[1] if len(centres) else None)
            cluster, near = np.full(len(unit), ZERO, np.int32), np.zeros(len(unit))
            rows = np.flatnonzero(unit.any(axis=1))
            if len(rows) and not len(centres):
                raise ValueError("the index has no centre for vectors that are not zero; build it anew")
            for start in range(0, len(rows), 1024):
                some = rows[start : start + 1024]
                cosines = unit[some] @ centres.T
                cluster[some] = cosines.argmax(axis=1)
                near[some] = cosines.max(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(cluster), ids, vectors, pa.array(near)], ["cluster", *batch.schema.names, "near"])

    kind = given.schema[chunk_id].dataType.simpleString()
    placed = given.mapInArrow(assign, f"cluster int, `{chunk_id}` {kind}, vector array<double>, near double")
    placed = stored(placed, "index-members")
    listed = [(int(i), [float(x) for x in row]) for i, row in enumerate(centres)] + [(ZERO, [])]
    known = spark.createDataFrame(listed, "cluster int, centre array<double>")
    reach = placed.groupBy("cluster").agg(F.min("near").alias("least"), F.count(F.lit(1)).alias("n"))
    # Clusters without members have a centre too, for chunks that come later.
    every = known.join(reach, "cluster", "left").select(
        "cluster", "centre", F.coalesce("least", F.lit(1.0)).alias("least"), F.coalesce("n", F.lit(0)).alias("n")
    )
    every.coalesce(1).write.mode("append").parquet(f"{path}/clusters")
    placed.limit(0).write.mode("ignore").parquet(f"{path}/columns")
    # Large clusters are split into files and small ones merged.
    placed.hint("rebalance", "cluster").write.mode("append").partitionBy("cluster").parquet(f"{path}/members")


def search_index(
    index: VectorIndex,
    questions: DataFrame,
    k: int,
    question_id: str = "question_id",
    vector: str = "embedding",
    on_bad_vector: Literal["raise", "drop"] = "raise",
) -> Found:
    """The ``k`` nearest chunks of every question: the rows that ``vector_top_k`` gives on all chunks.

    Each round is stored, and questions that are done take no part in the next. Clusters are gathered to
    columns, large ones are split, and a question is sent once to each column that it visits, with one bit
    for each cluster there; it is not sent once for each cluster. Members and questions meet in cells of a
    bounded number of entries on both sides, so neither a large cluster nor a popular one is one task.
    """
    spark = questions.sparkSession
    chunk_id = index.chunk_id
    asked = stored(_usable(questions, question_id, vector, on_bad_vector), "index-questions")
    schema = T.StructType(
        [
            T.StructField(question_id, asked.schema[question_id].dataType),
            T.StructField(chunk_id, index.members.schema[chunk_id].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    held = index.clusters.filter("n > 0").orderBy("cluster").toArrow()  # as many as centres
    sizes = dict(zip(held.column("cluster").to_pylist(), held.column("n").to_pylist(), strict=True))
    n_asked, n_chunks = asked.count(), sum(sizes.values())
    longest = max(_size(asked)[1], *(len(c or []) for c in held.column("centre").to_pylist()), 1)
    runs = _runs(list(sizes.values()), longest, 2 * spark.sparkContext.defaultParallelism)
    state = asked.withColumns({"floor": F.lit(-math.inf), "visited": F.lit(None).cast("binary")})
    hits = spark.createDataFrame([], schema)
    report = []
    for step in STEPS:
        planned = T.StructType([*state.schema.fields, T.StructField("next", T.BinaryType())])
        plan = stored(state.mapInArrow(_next_clusters(spark, held, step), planned), "index-plan").filter("next IS NOT NULL")
        visits, asking = _visits(plan, runs, len(sizes))
        if not any(visits):
            break
        report.append((len(report) + 1, n_asked, sum(n * size for n, size in zip(visits, sizes.values(), strict=True)), n_asked * n_chunks))
        found = _score(index, plan, runs, list(sizes), visits, asking, longest, k, schema)
        order = Window.partitionBy(question_id).orderBy(F.desc("score"), chunk_id)
        ranked = hits.union(found).withColumn("place", F.row_number().over(order))
        hits = stored(ranked.filter(F.col("place") <= k).drop("place"), "index-hits")
        if step is None:
            break
        floors = hits.groupBy(question_id).agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
        floors = floors.filter(F.col("n") == k).select(question_id, "least")
        state = plan.join(floors, question_id, "left").select(
            question_id, "vector", F.coalesce("least", F.lit(-math.inf)).alias("floor"), "visited"
        )
    order = Window.partitionBy(question_id).orderBy(F.desc("score"), chunk_id)
    told = spark.createDataFrame(report, "round int, n_questions bigint, n_scored bigint, n_all bigint")
    return Found(hits.withColumn("hit_rank", F.row_number().over(order)), told)


def _runs(sizes: list[int], longest: int, cells: int) -> list[tuple[int, int, int, int]]:
    """Clusters by place, gathered to columns: ``start, end, first column, number of columns`` of each run.

    A column has a bounded number of entries, and no more clusters than a vector has bits. There are no fewer
    than the root of the number of cells, so that small tables use all tasks too.
    """
    least = max(1, min(math.isqrt(max(0, cells - 1)) + 1, -(-sum(sizes) // 64)))
    room = max(1, min(GRID_CHUNK_ENTRIES, -(-sum(sizes) * longest // least)))
    ends, start, used = [], 0, 0
    for place, n in enumerate(sizes):
        if place > start and (used + n * longest > room or place - start >= 64 * longest):
            ends.append((start, place, 1))
            start, used = place, 0
        used += n * longest
        if used > room:
            ends.append((place, place + 1, -(-used // room)))
            start, used = place + 1, 0
    if start < len(sizes):
        ends.append((start, len(sizes), 1))
    firsts = np.cumsum([0, *(parts for _, _, parts in ends)]).tolist()
    return [(start, end, first, parts) for (start, end, parts), first in zip(ends, firsts, strict=False)]


def _bits(packed, n: int) -> np.ndarray:
    """A row of n booleans for each packed entry."""
    rows = np.frombuffer(b"".join(packed.to_pylist()), np.uint8).reshape(len(packed), -1)
    return np.unpackbits(rows, axis=1, count=n).astype(bool)


def _visits(plan: DataFrame, runs: list[tuple[int, int, int, int]], n: int) -> tuple[list[int], list[int]]:
    """Questions that visit each cluster, and each run of clusters."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(n + len(runs), np.int64)
        step = max(1, BLOCK_BITS // max(1, n))
        for batch in batches:
            for start in range(0, len(batch), step):
                bits = _bits(batch.column(0).slice(start, step), n)
                found[:n] += bits.sum(axis=0)
                found[n:] += [int(bits[:, begin:end].any(axis=1).sum()) for begin, end, _, _ in runs]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(found))), pa.array(found)], ["place", "n"])

    counted = plan.select("next").mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    held = {r.place: r.n for r in counted.collect()}  # as many as centres and runs
    return [held.get(i, 0) for i in range(n)], [held.get(n + i, 0) for i in range(len(runs))]


def _next_clusters(spark: SparkSession, held: pa.Table, step: int | None):
    """Adds to each question a bit for each cluster, set if it visits it next: the first ones by falling bound that may hold a hit.

    They count as visited from then on; a question that has none is done and gets NULL.
    """
    numbers = held.column("cluster").to_numpy()
    longest = max((len(c) for c in held.column("centre").to_pylist()), default=1) or 1
    centres = np.array([c or [0.0] * longest for c in held.column("centre").to_pylist()]).reshape(-1, longest)
    radius = np.arccos(np.clip(held.column("least").to_numpy(), -1.0, 1.0))
    shared = spark.sparkContext.broadcast((numbers, centres, radius))

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, centres, radius = shared.value
        for batch in batches:
            if not len(batch):
                continue
            # With nothing but zero vectors indexed every length of a question is as good.
            dimension = centres.shape[1] if centres.any() else None
            unit = _matrix(batch.column(0), batch.column(1), dimension)
            floors, visited = batch.column(2).to_numpy(), batch.column(3).to_pylist()
            taken, known = [], []
            for row in range(len(unit)):
                cosines = np.clip(centres @ unit[row], -1.0, 1.0) if dimension else np.zeros(len(centres))
                bound = np.cos(np.maximum(0.0, np.arccos(cosines) - radius - SLACK))
                # The score of a zero vector is 0, on either side.
                bound[numbers == ZERO] = 0.0
                if not unit[row].any():
                    bound[:] = 0.0
                may = bound + 10.0**-SCORE_DIGITS >= floors[row]
                seen = np.zeros(len(numbers), bool)
                if visited[row] is not None:
                    seen = np.unpackbits(np.frombuffer(visited[row], np.uint8), count=len(numbers)).astype(bool)
                may &= ~seen
                if step is not None:
                    order = np.lexsort((numbers, -bound))
                    first = order[may[order]][:step]
                    may[:] = False
                    may[first] = True
                taken.append(np.packbits(may).tobytes() if may.any() else None)
                known.append(np.packbits(seen | may).tobytes())
            columns = [*batch.columns[:3], pa.array(known, pa.binary()), pa.array(taken, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "next"])

    return plan


def _score(
    index: VectorIndex,
    plan: DataFrame,
    runs: list[tuple[int, int, int, int]],
    clusters: list[int],
    visits: list[int],
    asking: list[int],
    longest: int,
    k: int,
    schema: T.StructType,
) -> DataFrame:
    """The best ``k`` of each question in each cell of the columns that it visits."""
    spark, names = plan.sparkSession, schema.fieldNames()
    empty = to_arrow_schema(schema).empty_table()
    n_columns = sum(parts for _, _, _, parts in runs)
    wanted = -(-2 * spark.sparkContext.defaultParallelism // n_columns)
    slices = [max(1, -(-n * longest // GRID_QUESTION_ENTRIES), min(wanted, -(-n // 64))) for n in asking]
    grid = [
        (clusters[place], place - start, first, parts, n_slices)
        for (start, end, first, parts), n_slices in zip(runs, slices, strict=True)
        for place in range(start, end)
        if visits[place]
    ]
    kinds = "cluster int, _place int, _first int, _parts int, _slices int"
    cells = F.broadcast(spark.createDataFrame(grid, kinds))  # as many as centres
    part = F.pmod(F.xxhash64(names[1]), F.col("_parts").cast("long")).cast("int")
    members = index.members.filter(F.col("cluster").isin([row[0] for row in grid]))  # other partitions are not read
    given = members.join(cells, "cluster").select(
        (F.col("_first") + part).alias("_column"), F.explode(F.expr("sequence(0, _slices - 1)")).alias("_slice"), "_place", names[1], "vector"
    )

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BLOCK_BITS // len(clusters))
        for batch in batches:
            for at in range(0, len(batch), step):
                some = batch.slice(at, step)
                bits = _bits(some.column(3), len(clusters))
                for (start, end, first, parts), n_slices in zip(runs, slices, strict=True):
                    rows = np.flatnonzero(bits[:, start:end].any(axis=1))
                    if not len(rows):
                        continue
                    ids, vectors, floors, _, hashes = (column.take(pa.array(rows)) for column in some.columns)
                    packed = pa.array([bits.tobytes() for bits in np.packbits(bits[rows, start:end], axis=1)], pa.binary())
                    own = pa.array((hashes.to_numpy() % n_slices).astype(np.int32))
                    for column in range(first, first + parts):
                        place = pa.array(np.full(len(rows), column, np.int32))
                        yield pa.RecordBatch.from_arrays([place, own, ids, vectors, floors, packed], dealt.fieldNames())

    dealt = T.StructType(
        [
            T.StructField("_column", T.IntegerType()),
            T.StructField("_slice", T.IntegerType()),
            *plan.select(names[0], "vector", "floor", "next").schema.fields,
        ]
    )
    asked = plan.select(names[0], "vector", "floor", "next", F.xxhash64(names[0]).alias("_hash")).mapInArrow(deal, dealt)

    def best_of_cell(questions_in: pa.Table, chunks_in: pa.Table) -> pa.Table:
        if not (len(questions_in) and len(chunks_in)):
            return empty
        question_ids, chunk_ids = _ids(questions_in[names[0]]), _ids(chunks_in[names[1]])
        targets = _matrix(question_ids, questions_in["vector"])
        vectors = _matrix(chunk_ids, chunks_in["vector"], targets.shape[1])
        packed = np.frombuffer(b"".join(questions_in["next"].to_pylist()), np.uint8).reshape(len(targets), -1)
        places = chunks_in["_place"].to_numpy()
        order = np.argsort(places, kind="stable")
        scan = _Scan(targets, k, questions_in["floor"].to_numpy())
        for of_cluster in np.split(order, np.flatnonzero(np.diff(places[order])) + 1):
            place = int(places[of_cluster[0]])
            rows = np.flatnonzero(packed[:, place // 8] & (128 >> place % 8))
            if len(rows):
                scan.read(chunk_ids.take(pa.array(of_cluster)), vectors[of_cluster], rows)
        found = list(_result(scan.result(), question_ids, names))
        return pa.Table.from_batches(found) if found else empty

    cell = ("_column", "_slice")
    return asked.groupBy(*cell).cogroup(given.groupBy(*cell)).applyInArrow(best_of_cell, schema)
