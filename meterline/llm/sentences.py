"""Substring dedup by sliding runs of sentences.

A text is cut after the marks that end a sentence and line breaks, and before a capital letter
that follows a blank, which finds sentences put into the middle of another. From every sentence
the shortest run of sentences on with at least ``min_words`` words is hashed, and back from every
sentence as well, so that the ends of a passage are covered. Runs are joined over all documents;
those that are not the first with their text, by document id and position, are removed.

Defined results: a null or empty text has no sentences and nothing is removed; a text of fewer
words than ``min_words`` has no run; a repeated passage that holds no whole run stays, however
long; texts are cut whole; the second and later of rows equal in id and text lose all their text
if it has a run; null ids come last in the order. Runs are compared by a 64-bit hash and their
length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.llm.common import span_hashes, table, text_slices, word_spans
from meterline.llm.spans import row_key, without_spans

MIN_WORDS = 25
ENDS = np.zeros(256, bool)
ENDS[list(b".!?\n")] = True
#: Other capitals looked for are U+00C0 to U+00DE but for the sign U+00D7, all of two bytes.
_ASCII_CAPITAL = np.zeros(256, bool)
_ASCII_CAPITAL[0x41:0x5B] = True


def sentence_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Byte positions at which a sentence begins, for texts laid end to end."""
    if not len(data):
        return np.zeros(0, np.int64)
    after = np.append(data[1:], 0)
    capital = _ASCII_CAPITAL[data] | ((data == 0xC3) & (after >= 0x80) & (after <= 0x9E) & (after != 0x97))
    before = np.concatenate(([10], data[:-1]))
    begins = (ENDS[before] & ~ENDS[data]) | (capital & (before == 0x20))
    begins[bounds[:-1][bounds[:-1] < len(data)]] = True
    return np.flatnonzero(begins)


def sentence_runs(data: np.ndarray, bounds: np.ndarray, min_words: int):
    """(text, hash, start, end) of the shortest runs of at least ``min_words`` words."""
    begins = sentence_starts(data, bounds)
    starts, ends, owner = word_spans(data, bounds)
    first = np.searchsorted(starts, begins)  # words before each sentence
    has_word = np.append(first[1:], len(starts)) > first
    begins, first = begins[has_word], first[has_word]
    last = np.append(first[1:], len(starts))  # words up to each sentence's end
    text = owner[first]
    forth = np.searchsorted(last, first + min_words)  # the sentence that completes the run
    back = np.searchsorted(first, last - min_words, "right") - 1  # the sentence that opens it
    number = np.arange(len(begins))
    fits = forth < len(begins)
    fits[fits] = text[forth[fits]] == text[fits]
    from_here = np.stack((number[fits], forth[fits]))
    fits = back >= 0
    fits[fits] = text[back[fits]] == text[fits]
    pairs = np.unique(np.concatenate((from_here, np.stack((back[fits], number[fits]))), axis=1), axis=1)
    a, b = starts[first[pairs[0]]], ends[last[pairs[1]] - 1]
    return text[pairs[0]], span_hashes(data, a, b), a - bounds[text[pairs[0]]], b - bounds[text[pairs[0]]]


def _runs(min_words: int):
    """Runs of each text. Those that repeat an earlier run of the same batch are marked: they are
    not first in any case, so a passage of many texts sends one row a batch to its key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                (at + text, *more)
                for at, data, bounds in text_slices(batch.column(3))
                for text, *more in [sentence_runs(data, bounds, min_words)]
            ]
            if not found:
                continue
            text, key, start, end = (np.concatenate(parts) for parts in zip(*found, strict=True))
            docs = [(x is None, 0 if x is None else x, a, b) for x, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)]
            rank = {doc: i for i, doc in enumerate(sorted(set(docs)))}
            place = (np.array([rank[doc] for doc in docs], np.int64)[text] << 32) + start
            order = np.lexsort((place, key))
            opens = np.concatenate(([True], key[order][1:] != key[order][:-1]))[: len(order)]
            first = place[order][opens][np.cumsum(opens) - 1]
            again = np.zeros(len(order), bool)
            again[order] = place[order] > first
            columns = [batch.column(i).take(pa.array(text)) for i in range(3)]
            columns += [pa.array(x) for x in (key.view(np.int64), start.astype(np.int32), end.astype(np.int32), again)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row_1", "row_2", "key", "start", "end", "again"])

    return run


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row_1, row_2, start, end) in bytes of the runs that an earlier one repeats."""
    ids, texts = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    rows = docs.select(ids.alias("doc_id"), *row_key(ids, texts), texts.alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, row_1 bigint, row_2 bigint, key bigint, start int, end int, again boolean"
    runs = rows.mapInArrow(_runs(min_words), schema)
    # Runs known to be repeats are spread by document; the others are ranked in a stream of sorted rows.
    spread = runs.withColumn("spread", F.when(F.col("again"), F.col("row_1")))
    order = "order by doc_id is null, doc_id, row_1, row_2, start"
    place = f"dense_rank() over (partition by key, end - start, spread {order})"
    ranked = spread.withColumn("place", F.expr(place))
    return ranked.filter("again or place > 1").select("row_1", "row_2", "start", "end")


def dedup_sentences(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with a struct ``cut`` that holds the text without repeated runs of sentences."""
    spans = repeated_runs(docs, min_words, doc_id, text)
    return without_spans(docs, spans, doc_id, text, whole_copies=min_words)


def op7_sentence_spans(spark, sf_dir: str) -> DataFrame:
    docs = dedup_sentences(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "cut.n_bytes", "cut.n_removed", "cut.n_spans", F.col("cut.kept").alias("text"))
