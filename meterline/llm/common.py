"""Helpers that the operators share: stored tables, row digests, and hashes of words in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.session import scratch_dir

#: Bytes of text that a task handles at once; a longer text is handled alone.
SLICE_BYTES = 1 << 20


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows written to the shared folder and read back: a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(taken: Iterable[str], name: str) -> str:
    """The name, or name_1, name_2 and so on if a column is called so, whatever its case."""
    low, number, free = {column.lower() for column in taken}, 0, name
    while free.lower() in low:
        number += 1
        free = f"{name}_{number}"
    return free


def n_words(text: Column) -> Column:
    """Number of runs of characters other than blank, tab to carriage return; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


# ---------------------------------------------------------------- text as bytes, in numpy

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: 1 where a byte begins a code point.
BEGINS = np.ones(256, np.int64)
BEGINS[0x80:0xC0] = 0


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    """1, b, b^2, ... for an odd b or its inverse, modulo 2^64."""
    held = _powers[which]
    if len(held) < n:
        base = _BASE if which == "up" else pow(_BASE, -1, 1 << 64)
        size = max(n, SLICE_BYTES + 1)
        held = np.full(size, base & _MASK, np.uint64)
        held[0] = 1
        held = np.multiply.accumulate(held)
        if size == SLICE_BYTES + 1:
            _powers[which] = held
    return held[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span; equal bytes give equal hashes."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * _power("up", n), out=sums[1:])
    value = (sums[ends] - sums[starts]) * _power("down", n + 1)[starts]
    return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Index of the first text, the bytes of some texts end to end, and their bounds; null is empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield first, data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
        first = last


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts laid end to end, and the text each is of."""
    inside = ~IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before = np.concatenate(([False], inside))
    after = np.concatenate((inside, [False]))
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    return starts, ends, np.searchsorted(bounds, starts, "right") - 1


def gram_hashes(words: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n words within one text, and the index of each run's first word."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        factor = np.uint64(pow(_BASE, 2 * j + 1, 1 << 64))
        total += words[j : len(words) - n + 1 + j] * factor
    first = np.flatnonzero(owner[: len(words) - n + 1] == owner[n - 1 :])
    return mix(total[first]), first
