"""Removing spans of bytes from texts: shared by the operators that find repeated passages."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterline.llm.common import free_name


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Two hashes, 128 bits together, of a row's id and text; equal rows have equal keys."""
    return [F.xxhash64(doc_id, text).alias("row_1"), F.xxhash64(text, doc_id).alias("row_2")]


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of spans; spans that touch are one run."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    first = np.concatenate(([True], starts[1:] > ends[:-1]))
    return starts[first], np.append(ends[:-1][first[1:]], ends[-1])


_STRUCT = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept string"


def _cut(whole_copies: int):
    def run(texts: pa.Array, spans: pa.Array, copies: pa.Array) -> pa.Array:
        rows = []
        rows_in = zip(texts.to_pylist(), spans.to_pylist(), copies.to_pylist(), strict=True)
        for text, span, copy in rows_in:
            raw = (text or "").encode()
            bounds = np.array(span or (), np.int64)
            starts, ends = merged(bounds >> 32, bounds & 0xFFFFFFFF)
            if copy > 1 and len(raw.split()) >= whole_copies:
                starts, ends = np.array([0]), np.array([len(raw)])
            parts, at = [], 0
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                parts.append(raw[at:s])
                at = e
            kept = b"".join([*parts, raw[at:]])
            digest = hashlib.sha256(kept).hexdigest()
            rows.append((len(raw), len(raw) - len(kept), len(starts), digest, kept.decode("utf-8", "replace")))
        names = [part.split()[0] for part in _STRUCT.split(", ")]
        kinds = [pa.int64()] * 3 + [pa.string()] * 2
        columns = list(zip(*rows, strict=True)) or [()] * 5
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return pa.StructArray.from_arrays(arrays, names)

    return run


def without_spans(docs: DataFrame, spans: DataFrame, doc_id: str, text: str, whole_copies: int = 0) -> DataFrame:
    """The rows with a struct ``cut`` as the last column: the text without its spans, its digest, and counts.

    It is called ``cut_1``, or with the next free number, if the rows have a column ``cut``, which stays as it is.
    ``spans`` has (row_1, start, end) in bytes and possibly row_2; they are gathered by document.
    Equal rows share one key and report the same spans; each span is held once, from the tasks' partial lists on,
    so that a document's own length bounds the list however many rows equal it. With ``whole_copies`` the second and later of equal rows lose their whole text if it has
    so many words. Where a cut falls inside a character, ``kept`` holds the replacement character; the digest
    is of the bytes.
    """
    ids, texts = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    key = [name for name in ("row_1", "row_2") if name in spans.columns]
    span = F.shiftleft(F.col("start").cast("long"), 32).bitwiseOR(F.col("end").cast("long"))
    gathered = spans.groupBy(*key).agg(F.collect_set(span).alias("spans")).hint("merge")  # alike at every size
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, *row_key(ids, texts))
    joined = keyed.join(gathered, key, "left")
    copy = F.lit(1)
    if whole_copies:
        copy = F.row_number().over(Window.partitionBy("row_1", "row_2").orderBy("row_1"))
    joined = joined.withColumn("copy", copy)
    cut = F.arrow_udf(_cut(whole_copies), _STRUCT).asNondeterministic()
    done = joined.select("row", cut(F.col(f"row.`{text}`"), "spans", "copy").alias("cut"))
    return done.select("row.*", F.col("cut").alias(free_name(docs.columns, "cut")))
