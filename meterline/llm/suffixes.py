"""Suffix-array dedup: every byte covered by a long string that occurs elsewhere, by induced sorting.

All texts cannot be sorted in one place, so they are first cut into segments such that equal
strings of the wanted length fall to the same shard. Each window of that length has an anchor:
the least hash of the short grams within it. Successive windows with an equal anchor are one
segment. Equal windows have equal anchors, so

* a segment whose bytes and anchor occur again is repeated as a whole, and
* other repeats lie between or within segments of the same anchor, which are one shard.

A shard's segments are laid end to end and their suffix array is built by induced sorting:
suffixes are classed as larger or smaller than the next, leftmost-smaller substrings are named
and sorted recursively, and all other suffixes follow by two linear passes. Neighbours of the
array are then tested, in text order, for equal bytes over the length of a window; prefix lengths
themselves are not formed. Windows that equal a neighbour are repeated. A shard too large for one task is dealt out, and
windows that are alone in their part are compared with the other parts by 128-bit digests.

Defined results: null is empty; texts shorter than the window keep all bytes; matches never
cross texts; copies lose all bytes, the first one too; repeated rows are copies of each other.
Segments and rows are told apart by two 64-bit hashes each, rows by those of id and text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterline.llm.common import mix, span_hashes, stored, table, text_slices
from meterline.llm.spans import row_key, without_spans

LENGTH = 200
#: Bytes of the grams whose least hash anchors a window.
GRAM = 50
#: Bytes of whole shards that are sorted together, and of a shard above which it is dealt out.
BATCH_BYTES, SHARD_BYTES = 1 << 20, 1 << 23


# ---------------------------------------------------------------- induced sorting


def suffix_array(text: np.ndarray, size: int = 256) -> np.ndarray:
    """The starts of the suffixes in order, for symbols 0 to size - 1."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    smaller = _classes(text)
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    counts = np.bincount(text, minlength=size)
    ends = np.cumsum(counts)
    induce = _induce if size <= 256 else _induce_wide
    order = induce(text, smaller, leftmost, ends - counts, ends)
    if len(leftmost) < 2:
        return order
    # Name the leftmost-smaller substrings in their sorted order; equal ones share a name.
    place = np.full(n, -1)
    place[leftmost] = np.arange(len(leftmost))
    in_order = place[order]
    in_order = in_order[in_order >= 0]
    stop = np.append(leftmost[1:] + 1, n)
    width = stop - leftmost
    value = span_hashes(text.astype(np.uint8), leftmost, stop) if size <= 256 else _wide_hashes(text, leftmost, stop)
    value[-1] = mix(value[-1:] ^ np.uint64(1))[0]  # the last one ends with the text
    value, width = value[in_order], width[in_order]
    differs = np.concatenate(([True], (value[1:] != value[:-1]) | (width[1:] != width[:-1])))
    names = np.empty(len(leftmost), np.int64)
    names[in_order] = np.cumsum(differs) - 1
    n_names = int(np.count_nonzero(differs))
    if n_names < len(leftmost):
        in_order = suffix_array(names, max(n_names, 257))
    return induce(text, smaller, leftmost[in_order], ends - counts, ends)


def _wide_hashes(text: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of runs of symbols of more than a byte."""
    at = np.arange(len(text), dtype=np.uint64)
    number = np.repeat(np.arange(len(start)), stop - start)
    within = np.arange(len(number)) - np.repeat(np.cumsum(stop - start) - (stop - start), stop - start)
    value = mix(text[start[number] + within].astype(np.uint64) * np.uint64(2) + np.uint64(1)) * (
        mix(at[within] + np.uint64(7)) | np.uint64(1)
    )
    return mix(np.add.reduceat(value, np.cumsum(stop - start) - (stop - start)))


def _classes(symbols: np.ndarray) -> np.ndarray:
    """Is each suffix smaller than the next one? The last is larger than the empty one."""
    n = len(symbols)
    change = np.flatnonzero(symbols[1:] != symbols[:-1])
    rises = symbols[change] < symbols[change + 1]
    smaller = np.zeros(n, bool)
    if len(change):
        run = np.diff(np.concatenate(([-1], change)))
        smaller[: change[-1] + 1] = np.repeat(rises, run)
    return smaller


def _induce(text: np.ndarray, smaller: np.ndarray, leftmost: np.ndarray, starts, ends) -> np.ndarray:
    """All suffixes in order, from the leftmost-smaller ones in the order given.

    Two passes over the buckets of first symbols. What a bucket holds is known once the buckets
    before it are done, but for suffixes that begin with the symbol twice, which come in waves.
    """
    n, size = len(text), len(ends)
    order = np.empty(n, np.int64)
    symbol = text.astype(np.uint8)
    placed = np.bincount(symbol[leftmost], minlength=size)
    by_symbol = leftmost[np.argsort(symbol[leftmost], kind="stable")]
    order[np.arange(len(leftmost)) + np.repeat(ends - placed - (np.cumsum(placed) - placed), placed)] = by_symbol

    def push(block: np.ndarray, free: np.ndarray, kind: bool, step: int) -> None:
        before = block[block > 0] - 1
        before = before[smaller[before] == kind]
        if not len(before):
            return
        first = symbol[before]
        by_first = np.argsort(first, kind="stable")
        first = first[by_first]
        many = np.bincount(first, minlength=size)
        rank = np.arange(len(first)) - (np.cumsum(many) - many)[first]
        order[(free[first] if step > 0 else free[first] - 1) + step * rank] = before[by_first]
        free += step * many

    head = starts.copy()
    order[head[symbol[-1]]] = n - 1
    head[symbol[-1]] += 1
    used = np.flatnonzero(ends > starts)
    for c in used.tolist():  # larger suffixes, each from the one after it
        at = starts[c]
        while at < head[c]:
            at, wave = head[c], order[at : head[c]]
            push(wave, head, False, 1)
        push(order[ends[c] - placed[c] : ends[c]], head, False, 1)
    tail = ends.copy()
    for c in used[::-1].tolist():  # smaller suffixes, from the right
        at = ends[c]
        while at > tail[c]:
            at, wave = tail[c], order[tail[c] : at][::-1]
            push(wave, tail, True, -1)
        push(order[starts[c] : head[c]][::-1], tail, True, -1)
    return order


def _induce_wide(symbols: np.ndarray, smaller: np.ndarray, leftmost: np.ndarray, starts, ends) -> np.ndarray:
    """``_induce`` for many symbols, whose buckets are too small to be worth handling as a whole."""
    text, kind, n = symbols.tolist(), smaller.tobytes(), len(symbols)
    order = [0] * n
    tail = ends.tolist()
    for i in leftmost[::-1].tolist():
        at = tail[text[i]] = tail[text[i]] - 1
        order[at] = i
    head = starts.tolist()
    order[head[text[-1]]] = n - 1
    head[text[-1]] += 1
    for k in range(n):  # a free place holds 0, which has no suffix before it
        i = order[k] - 1
        if i >= 0 and not kind[i]:
            c = text[i]
            order[head[c]] = i
            head[c] += 1
    tail = ends.tolist()
    for k in range(n - 1, -1, -1):
        i = order[k] - 1
        if i >= 0 and kind[i]:
            c = text[i]
            at = tail[c] = tail[c] - 1
            order[at] = i
    return np.array(order)


def repeated_windows(data: bytes, window: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the windows (starts) repeat another, and which is the first in order of its kind."""
    wanted = np.zeros(len(data) + 1, bool)
    wanted[window] = True
    order = suffix_array(np.frombuffer(data, np.uint8))
    order = order[wanted[order]]
    words = np.frombuffer(data + bytes(8), np.uint8)
    packed = np.zeros(len(data), np.uint64)
    for k in range(8):
        packed |= words[k : k + len(data)].astype(np.uint64) << np.uint64(8 * k)
    # Is the suffix before equal over ``length`` bytes? Taken in text order; no prefix lengths are formed.
    before = np.full(len(data), -1, np.int64)
    before[order[1:]] = order[:-1]
    here = np.flatnonzero(before >= 0)
    offsets = [*range(0, length - 7, 8), length - 8] if length >= 8 else []
    for offset in offsets:
        here = here[packed[here + offset] == packed[before[here] + offset]]
    if length < 8:
        for offset in range(length):
            here = here[words[here + offset] == words[before[here] + offset]]
    long = np.zeros(len(data), bool)
    long[here] = True
    same = long[order]  # as the one before
    repeats, opens = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    repeats[order] = same | np.append(same[1:], False)
    opens[order] = ~same
    return repeats[window], opens[window]


# ---------------------------------------------------------------- segments


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of each ``width`` successive values, by doubling."""
    done = 1
    while 2 * done <= width:
        values = pick(values[: len(values) - done], values[done:])
        done *= 2
    return pick(values[: len(values) - (width - done)], values[width - done :]) if width > done else values


def segments(data: np.ndarray, bounds: np.ndarray, length: int, gram: int):
    """(text, anchor, digest, start, size, twice) of the segments of texts laid end to end.

    ``twice`` says that the anchor stands at two places of the segment or more: only then can
    two windows of the segment be equal.
    """
    n = len(data)
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none, none.astype(bool)
    at = np.arange(n - gram + 1)
    grams = span_hashes(data, at, at + gram)
    span = length - gram + 1
    least = _sliding(grams, span, np.minimum)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(least)]
    valid = np.arange(len(least)) + length <= bounds[owner + 1]
    opens = valid.copy()
    opens[1:] &= ~valid[:-1] | (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
    closes = valid.copy()
    closes[:-1] &= ~valid[1:] | opens[1:]
    start, last = np.flatnonzero(opens), np.flatnonzero(closes)
    text, anchor = owner[start], least[start]

    around = np.zeros(len(grams) + span - 1, np.uint64)
    around[span - 1 : span - 1 + len(least)] = np.where(valid, least, 0)
    places = np.flatnonzero(_sliding(around, span, np.maximum) == grams)  # grams that are some window's least
    first, stop = np.searchsorted(places, start), np.searchsorted(places, last + span)
    number = np.repeat(np.arange(len(start)), stop - first)
    each = places[np.arange(len(number)) + np.repeat(first - (np.cumsum(stop - first) - (stop - first)), stop - first)]
    twice = np.bincount(number[grams[each] == anchor[number]], minlength=len(start)) > 1
    end = last + length
    return text, anchor, span_hashes(data, start, end), start - bounds[text], end - start, twice


SEGMENT = "anchor bigint, digest bigint, size int, row_1 bigint, row_2 bigint, start int, twice boolean"


def _segments(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row_1, row_2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at, data, bounds in text_slices(batch.column(2)):
                text, anchor, digest, start, size, twice = segments(data, bounds, length, gram)
                columns = [anchor.view(np.int64), digest.view(np.int64), size.astype(np.int32), row_1[at + text], row_2[at + text]]
                columns = [pa.array(c) for c in (*columns, start.astype(np.int32), twice)]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SEGMENT.split(", ")])

    return run


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted segments of each text."""
    for batch in batches:
        out = []
        for row_1, row_2, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = text.encode()
            out += [(w["anchor"], w["part"], w["parts"], row_1, row_2, w["start"], raw[w["start"] : w["start"] + w["size"]]) for w in wanted]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        columns = [pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(columns, ["anchor", "part", "parts", "row_1", "row_2", "start", "bytes"])


FOUND = "row_1 bigint, row_2 bigint, start int, end int, key_1 bigint, key_2 bigint"


def _sort_shards(length: int):
    """Repeats within shards. Rows without a key are repeated spans; those with one are windows of
    a shard in several parts, one for each kind that the part holds."""

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        columns = [pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in FOUND.split(", ")])

    def sort(rows: list[tuple]) -> list[tuple]:
        data = b"".join(r[2] for r in rows)
        sizes = np.array([len(r[2]) for r in rows])
        begin = np.cumsum(sizes) - sizes
        number = np.repeat(np.arange(len(rows)), sizes - length + 1)
        first = np.cumsum(sizes - length + 1) - (sizes - length + 1)
        window = begin[number] + np.arange(len(number)) - first[number]
        repeats, opens = repeated_windows(data, window, length)
        found = []
        hit, of = window[repeats], number[repeats]
        if len(hit):
            new = np.flatnonzero(np.concatenate(([True], (hit[1:] != hit[:-1] + 1) | (of[1:] != of[:-1]))))
            last = np.append(new[1:], len(hit)) - 1
            for a, b in zip(new.tolist(), last.tolist(), strict=True):
                row, start, _, _ = rows[of[a]]
                offset = start - int(begin[of[a]])
                found.append((*row, int(hit[a]) + offset, int(hit[b]) + offset + length, None, None))
        split = np.array([r[3] for r in rows])[number] & opens
        if split.any():
            array = np.frombuffer(data, np.uint8)
            one = span_hashes(array, window[split], window[split] + length)
            two = span_hashes(array ^ np.uint8(0x5A), window[split], window[split] + length)
            for w, k, x, y in zip(window[split].tolist(), number[split].tolist(), one.view(np.int64).tolist(), mix(two).view(np.int64).tolist(), strict=True):
                start = rows[k][1] + w - int(begin[k])
                found.append((*rows[k][0], start, start + length, x, y))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, key = [], 0, None
        for batch in batches:
            found = []
            for anchor, part, parts, row_1, row_2, start, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (anchor, part) != key and (size >= BATCH_BYTES or parts > 1 or (held and held[-1][3])):
                    found += sort(held) if held else []
                    held, size = [], 0
                key = (anchor, part)
                held.append(((row_1, row_2), start, raw, parts > 1))
                size += len(raw)
            yield batch_of(found)
        if held:
            yield batch_of(sort(held))

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row_1, row_2, start, end) in bytes: spans all of whose windows of ``length`` bytes occur elsewhere."""
    ids, texts = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    rows = docs.select(*row_key(ids, texts), texts.alias("text")).filter(F.octet_length("text") >= length)
    cut = rows.mapInArrow(_segments(length, gram), SEGMENT)
    content = ("anchor", "digest", "size")
    kinds = cut.groupBy(*content).agg(F.count("*").alias("n"), F.min(F.struct("row_1", "row_2", "start")).alias("first"), F.max("twice").alias("twice"))
    shard = Window.partitionBy("anchor")
    kinds = kinds.select(
        *content, "n", "first", "twice",
        F.count("*").over(shard).alias("members"),
        F.sum(F.col("size").cast("long")).over(shard).alias("bytes"),
    )
    kinds = stored(kinds.filter("n > 1 or members > 1 or twice"), "segment-kinds")
    again = kinds.filter("n > 1").select(*content)
    whole = cut.join(again.hint("merge"), list(content)).select("row_1", "row_2", "start", (F.col("start") + F.col("size")).alias("end"))

    parts = F.ceil(F.col("bytes") / SHARD_BYTES).cast("int")
    wanted = kinds.filter("members > 1 or twice").select(
        F.col("first.row_1").alias("row_1"), F.col("first.row_2").alias("row_2"),
        F.struct(
            "anchor", parts.alias("parts"), F.pmod("digest", parts).cast("int").alias("part"),
            F.col("first.start").alias("start"), "size",
        ).alias("wanted"),
    )
    wanted = wanted.groupBy("row_1", "row_2").agg(F.collect_list("wanted").alias("wanted"))  # as many as a text has segments
    # Equal rows have equal keys; one of them gives the bytes.
    row = ["row_1", "row_2"]
    one = rows.join(wanted.hint("merge"), row).dropDuplicates(row).select(*row, "text", "wanted")
    slices = one.mapInArrow(_slices, "anchor bigint, part int, parts int, row_1 bigint, row_2 bigint, start int, bytes binary")
    key = ("anchor", "part")
    found = slices.repartition(*key).sortWithinPartitions(*key).mapInArrow(_sort_shards(length), FOUND)
    found = stored(found, "segment-repeats")
    split = found.filter("key_1 is not null")
    several = split.groupBy("key_1", "key_2").agg(F.count("*").alias("n")).filter("n > 1")
    across = split.join(several, ["key_1", "key_2"]).select(*row, "start", "end")
    return whole.union(found.filter("key_1 is null").select(*row, "start", "end")).union(across)


def dedup_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with a struct ``cut``: the text without bytes that repeated strings cover, and counts."""
    return without_spans(docs, repeated_spans(docs, length, gram, doc_id, text), doc_id, text)


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = dedup_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "cut.n_bytes", "cut.n_removed", "cut.n_spans", "cut.kept_sha256")
