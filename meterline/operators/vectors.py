"""Exact nearest chunks by cosine, for a whole table of questions at once."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import Literal

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# The task functions below travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCORE_DIGITS = 6
# Entries of all question vectors together that may be broadcast (32 MB as doubles).
BROADCAST_ENTRIES = 4_000_000
# Vector entries per side in one cell of the grid join (32 and 128 MB as doubles).
GRID_QUESTION_ENTRIES = 4_000_000
GRID_CHUNK_ENTRIES = 16_000_000
# Scores computed at a time in one task, and candidates held before they are merged.
BLOCK_SCORES = 2_000_000
PENDING = 1_000_000


def vector_top_k(
    chunks: DataFrame,
    questions: DataFrame,
    k: int,
    chunk_id: str = "chunk_id",
    question_id: str = "question_id",
    vector: str = "embedding",
    layout: Literal["grid", "broadcast"] = "grid",
    on_bad_vector: Literal["raise", "drop"] = "raise",
) -> DataFrame:
    """The ``k`` nearest chunks of every question: ``question_id, chunk_id, score, hit_rank``.

    The score is the cosine rounded to six digits, ties go to the smaller chunk id, and
    both ids are unique. Only ids and vectors are read here, so the caller joins texts to
    the few results. Rows without an id or with an empty vector take no part. A vector with
    a NULL or non-finite entry is an error that names its id, or is left out with
    ``on_bad_vector="drop"``; vectors of different lengths are an error. A zero vector has
    the score 0.

    ``layout`` says how the two sides meet. ``grid`` works for every size: question cells times
    chunk cells, each of a bounded number of entries, with the best ``k`` kept per cell; the
    cells follow from a count of both sides. ``broadcast`` is for few questions, which it
    fetches once and sends to every task; the chunks are then read without a shuffle. It is
    an error if their vectors have more than ``BROADCAST_ENTRIES`` entries. A pair that is no
    result is never a row.
    """
    if layout not in ("grid", "broadcast"):
        raise ValueError(f"layout must be 'grid' or 'broadcast', not {layout!r}")
    left = _usable(chunks, chunk_id, vector, on_bad_vector)
    right = _usable(questions, question_id, vector, on_bad_vector)
    schema = T.StructType(
        [
            T.StructField(question_id, right.schema[question_id].dataType),
            T.StructField(chunk_id, left.schema[chunk_id].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    best = (_on_grid if layout == "grid" else _with_broadcast)(left, right, k, schema)
    order = Window.partitionBy(question_id).orderBy(F.desc("score"), chunk_id)
    ranked = best.withColumn("hit_rank", F.row_number().over(order))
    return ranked.filter(F.col("hit_rank") <= k)


def _usable(df: DataFrame, id_name: str, vector: str, on_bad: str) -> DataFrame:
    if on_bad not in ("raise", "drop"):
        raise ValueError(f"on_bad_vector must be 'raise' or 'drop', not {on_bad!r}")
    values = F.col(vector).cast("array<double>")
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    given = df.filter(F.col(id_name).isNotNull() & (F.size(values) > 0))
    if on_bad == "drop":
        return given.filter(~bad).select(id_name, values.alias("vector"))
    told = F.concat(F.lit("the vector of "), F.col(id_name).cast("string"), F.lit(" has a NULL or non-finite entry"))
    return given.select(id_name, F.when(bad, F.raise_error(told)).otherwise(values).alias("vector"))


def _size(vectors: DataFrame) -> tuple[int, int]:
    """Number of vectors, and entries of the longest."""
    count, longest = vectors.agg(F.count("vector"), F.max(F.size("vector"))).first()
    return count, longest or 1


def _matrix(ids, column, dimension: int | None = None) -> np.ndarray:
    """Rows of unit length; a zero vector stays zero. All must have one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    dimension = dimension or (int(lengths[0]) if len(lengths) else 1)
    if (odd := np.flatnonzero(lengths != dimension)).size:
        raise ValueError(f"the vector of {ids[int(odd[0])]} has {lengths[odd[0]]} entries, not {dimension}")
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)
    # Scaled by the largest entry first, so that no square overflows.
    largest = np.abs(rows).max(axis=1, keepdims=True, initial=0)
    rows = np.divide(rows, largest, out=np.zeros_like(rows), where=largest > 0)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=rows, where=norms > 0)


def _best(candidates: pa.Table, k: int) -> pa.Table:
    """The first k candidates of each question by falling score, then by id."""
    ordered = candidates.sort_by(
        [("question", "ascending"), ("score", "descending"), ("id", "ascending")]
    )
    question = ordered["question"].to_numpy()
    starts = np.flatnonzero(np.r_[True, question[1:] != question[:-1]]) if len(question) else []
    lengths = np.diff(np.r_[starts, len(question)]).astype(int)
    place = np.arange(len(question)) - np.repeat(starts, lengths)
    return ordered.filter(pa.array(place < k))


class _Scan:
    """The best k chunks per target while chunks are read.

    Each target has a floor, its k-th score so far or a given one; only scores that reach it
    are kept, and candidates are merged when many have gathered.
    """

    def __init__(self, targets: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.targets, self.k = targets, k
        self.given = np.full(len(targets), -np.inf) if floor is None else floor
        self.floor = self.given
        self.best: pa.Table | None = None
        self.pending: list[pa.Table] = []
        self.held = 0

    def read(self, ids: pa.Array, vectors: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Score the chunks for all targets, or for those of the given rows."""
        targets = self.targets if rows is None else self.targets[rows]
        step = max(1, BLOCK_SCORES // max(1, len(targets)))
        for start in range(0, len(vectors), step):
            scores = vectors[start : start + step] @ targets.T
            floor = self.floor if rows is None else self.floor[rows]
            is_open = self.best is None if rows is None else np.isneginf(floor).any()
            if is_open and len(scores) > self.k:
                # Everything from the k-th score upwards, ties included.
                kth = np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k]
                floor = np.maximum(floor, kth)
            row, question = np.nonzero(scores >= floor - 10.0**-SCORE_DIGITS)
            found = {
                "question": pa.array(question if rows is None else rows[question]),
                "id": ids.take(pa.array(row + start)),
                "score": pa.array(np.round(scores[row, question], SCORE_DIGITS) + 0.0),
            }
            self.pending.append(pa.table(found))
            self.held += len(row)
            if self.best is None or self.held > max(PENDING, self.k * len(self.targets)):
                self.merge()

    def merge(self) -> None:
        tables = self.pending if self.best is None else [self.best, *self.pending]
        self.best = _best(pa.concat_tables(tables), self.k) if tables else None
        self.pending, self.held = [], 0
        if self.best is not None:
            question = self.best["question"].to_numpy()
            full = np.bincount(question, minlength=len(self.targets)) == self.k
            least = np.full(len(self.targets), np.inf)
            np.minimum.at(least, question, self.best["score"].to_numpy())
            self.floor = np.maximum(self.given, np.where(full, least, -np.inf))

    def result(self) -> pa.Table | None:
        if self.pending:
            self.merge()
        return self.best


def _result(best: pa.Table | None, question_ids: pa.Array, names: list[str]):
    if best is not None:
        taken = question_ids.take(best["question"].combine_chunks())
        yield from pa.table([taken, best["id"], best["score"]], names=names).to_batches()


def _ids(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _with_broadcast(chunks: DataFrame, questions: DataFrame, k: int, schema) -> DataFrame:
    count, longest = _size(questions)
    if count * longest > BROADCAST_ENTRIES:
        raise ValueError(f"{count} questions of {longest} entries are too many to broadcast; use layout='grid'")
    asked = questions.toArrow()
    ids = _ids(asked.column(0))
    shared = chunks.sparkSession.sparkContext.broadcast((ids, _matrix(ids, asked.column(1))))
    names = schema.fieldNames()

    def best_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        question_ids, targets = shared.value
        scan = _Scan(targets, k)
        for batch in batches:
            if len(targets) and len(batch):
                scan.read(batch.column(0), _matrix(batch.column(0), batch.column(1), targets.shape[1]))
        yield from _result(scan.result(), question_ids, names)

    return chunks.mapInArrow(best_of_task, schema)


def _on_grid(chunks: DataFrame, questions: DataFrame, k: int, schema) -> DataFrame:
    asked_count, asked_size = _size(questions)
    given_count, given_size = _size(chunks)
    rows = max(1, -(-asked_count * asked_size // GRID_QUESTION_ENTRIES))
    columns = max(1, -(-given_count * given_size // GRID_CHUNK_ENTRIES))
    # No fewer cells than tasks, so that small tables use all of them too.
    tasks = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = max(columns, min(-(-tasks // rows), -(-given_count // 64)), 1)
    names = schema.fieldNames()
    empty = to_arrow_schema(schema).empty_table()

    def cell(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        slot = F.pmod(F.xxhash64(df.columns[0]), F.lit(n_own).cast("long")).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))
        return df.withColumn(own, slot).withColumn(other, every)

    def best_of_cell(questions_in: pa.Table, chunks_in: pa.Table) -> pa.Table:
        if not (len(questions_in) and len(chunks_in)):
            return empty
        question_ids, chunk_ids = _ids(questions_in[names[0]]), _ids(chunks_in[names[1]])
        scan = _Scan(_matrix(question_ids, questions_in["vector"]), k)
        scan.read(chunk_ids, _matrix(chunk_ids, chunks_in["vector"], scan.targets.shape[1]))
        found = list(_result(scan.result(), question_ids, names))
        return pa.Table.from_batches(found) if found else empty

    asked = cell(questions, "_row", rows, "_column", columns)
    given = cell(chunks, "_column", columns, "_row", rows)
    return (
        asked.groupBy("_row", "_column")
        .cogroup(given.groupBy("_row", "_column"))
        .applyInArrow(best_of_cell, schema)
    )
