"""Quality rules from repetition: words and characters inside repeated n-grams and lines.

Hashes of every run of n words are formed in numpy for a slice of texts at once, for several
n, and runs found twice within a text mark the words that they cover. A word counts once for
each n, the first occurrence included.

Defined results: a null or empty text has no words and fails the base rule; very long texts
are measured whole; rows are judged one by one, so ties and repeated rows get equal results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.llm.common import (
    BEGINS,
    gram_hashes,
    mix,
    span_hashes,
    table,
    text_slices,
    word_spans,
)

BASE_GRAM = 5
#: Largest share of a text's word characters inside n-grams found twice or more.
GRAM_SHARES = {6: 0.25, 8: 0.22, 10: 0.20}
#: Largest share of a text's word characters in lines that occur twice or more.
LINE_SHARE = 0.30
#: Largest number of marks such as # and | for each word.
SYMBOL_SHARE = 0.5
MIN_WORDS = 10

SYMBOLS = np.zeros(256, np.int64)
SYMBOLS[list(b"#*$%&|<>")] = 1

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars")
_STRUCT = (
    ", ".join(f"{name} bigint" for name in COUNTS)
    + "".join(f", dup_chars_{n} bigint" for n in GRAM_SHARES)
    + ", base_failed boolean, kept boolean"
)


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: is there an equal one, and is there an equal one before it?"""
    order = np.argsort(keys, kind="stable")
    equal = keys[order][1:] == keys[order][:-1]
    again = np.zeros(len(keys), bool)
    again[order[1:]] = equal
    any_other = again.copy()
    any_other[order[:-1]] |= equal
    return any_other, again


def _covered(first: np.ndarray, n: int, n_words: int) -> np.ndarray:
    """Which words lie in one of the runs of n words that begin at these words."""
    steps = np.zeros(n_words + 1, np.int64)
    np.add.at(steps, first, 1)
    np.add.at(steps, first + n, -1)
    return np.cumsum(steps[:-1]) > 0


def _measure(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    n_texts = len(bounds) - 1
    starts, ends, owner = word_spans(data, bounds)
    points = np.concatenate(([0], np.cumsum(BEGINS[data])))
    chars = points[ends] - points[starts]
    words = span_hashes(data, starts, ends)
    salt = mix(np.arange(1, n_texts + 1, dtype=np.uint64))

    def per_text(of: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(of, weight, minlength=n_texts).astype(np.int64)

    found = {"n_words": per_text(owner), "word_chars": per_text(owner, chars)}
    marks = np.concatenate(([0], np.cumsum(SYMBOLS[data])))
    found["n_symbols"] = marks[bounds[1:]] - marks[bounds[:-1]]

    breaks = np.flatnonzero(data == 10)
    line_starts = np.union1d(bounds[:-1][bounds[:-1] < bounds[1:]], breaks + 1)
    line_starts = line_starts[line_starts < len(data)]
    if len(line_starts):
        line_ends = np.append(line_starts[1:], len(data))
        line_ends = line_ends - (data[line_ends - 1] == 10)
        line_words = np.searchsorted(starts, line_ends) - np.searchsorted(starts, line_starts)
        kept = line_words > 0
        line_starts, line_ends = line_starts[kept], line_ends[kept]
        line_owner = np.searchsorted(bounds, line_starts, "right") - 1
        either, again = _repeated(span_hashes(data, line_starts, line_ends) ^ salt[line_owner])
        word_points = np.concatenate(([0], np.cumsum(chars)))
        line_chars = (
            word_points[np.searchsorted(starts, line_ends)]
            - word_points[np.searchsorted(starts, line_starts)]
        )
        found["n_dup_lines"] = per_text(line_owner[again])
        found["dup_line_chars"] = per_text(line_owner[either], line_chars[either])
    else:
        found["n_dup_lines"] = found["dup_line_chars"] = np.zeros(n_texts, np.int64)

    for n in (BASE_GRAM, *GRAM_SHARES):
        keys, first = gram_hashes(words, owner, n)
        either, _ = _repeated(keys ^ salt[owner[first]])
        inside = _covered(first[either], n, len(words))
        if n == BASE_GRAM:
            found["n_repeat_words"] = per_text(owner[inside])
        else:
            found[f"dup_chars_{n}"] = per_text(owner[inside], chars[inside])

    failed = (found["n_words"] < MIN_WORDS) | (100 * found["n_repeat_words"] > 20 * found["n_words"])
    good = ~failed & (found["n_symbols"] <= SYMBOL_SHARE * found["n_words"])
    for n, share in GRAM_SHARES.items():
        good &= found[f"dup_chars_{n}"] <= share * found["word_chars"]
    good &= found["dup_line_chars"] <= LINE_SHARE * found["word_chars"]
    return found | {"base_failed": failed, "kept": good}


def _quality(texts: pa.Array) -> pa.Array:
    parts = [_measure(data, bounds) for _, data, bounds in text_slices(texts)]
    names = [*COUNTS, *(f"dup_chars_{n}" for n in GRAM_SHARES), "base_failed", "kept"]
    kinds = [np.int64] * (len(names) - 2) + [bool] * 2
    columns = [
        pa.array(np.concatenate([p[name] for p in parts]) if parts else np.zeros(0, kind))
        for name, kind in zip(names, kinds, strict=True)
    ]
    return pa.StructArray.from_arrays(columns, names)


def quality(text: Column) -> Column:
    """Counts and verdict of a text as a struct: ``base_failed``, ``kept`` and what led to them."""
    # Marked so that it is evaluated once, however often its fields are used.
    return F.arrow_udf(_quality, _STRUCT).asNondeterministic()(text)


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text the rules keep, with their columns unchanged."""
    names = [F.col(f"doc.`{c}`").alias(c) for c in docs.columns]
    judged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), quality(F.col(f"`{text}`")).alias("verdict"))
    return judged.filter("verdict.kept").select(*names)


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", quality(F.col("text")).alias("q")).select("doc_id", "q.*")
