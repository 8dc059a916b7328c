"""N-gram Jaccard join: a sparse product of the matrix of documents by n-grams, in blocks.

Of a set of s n-grams, a set linked with it lacks at most d(s) = floor(s (100 - t) / 100). So if
each set gives its first l(s) = min(s, 2 d(s) + 1) columns in any one order of all columns, two
linked sets share l - d of these, for the size of the one whose columns end first. A second
order of the given columns then leaves l(s) + 1 less l - d at the least size that may be linked,
ceil(t s / 100), and linked sets still share one of them. The first order is by the size of
counters, of a fixed number, that columns are hashed to and that are summed over all documents:
what very many documents share comes last and brings no rows to one task. The second is by the
exact number of sets that give the column; columns of one set need not be looked at again. Only
rows that still share a column can be linked, and only if their sizes are near enough and so are
their sketches: each n-gram flips one bit of few, and every bit in which two sketches differ stands
for an n-gram that one set lacks. Rows that pass fall into one cluster, so a column that strangers
share by chance, as more and more do in a growing corpus, joins none.

Within a cluster, rows are dealt into blocks of bounded size, and every pair of blocks is
multiplied over blocks of columns: where a column has few rows, only its products that are not
zero are added up, otherwise whole panels are multiplied. Overlap counts accumulate; pairs whose
sizes or remaining columns cannot reach the bound are discarded. A product returns the
components of its links, not its pairs. Equal sets are one row throughout, so copies cost nothing.

N-grams are compared by 64-bit hashes and sets by 128-bit digests.

Defined results: null, empty and wordless texts have no n-grams and link with nothing; a text
with fewer than n words has one n-gram, all its words; texts are read whole; repeated rows are
equal sets and so linked; a null document id counts as larger than any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterline.llm.common import (
    LOWER,
    gram_hashes,
    mix,
    span_hashes,
    stored,
    table,
    text_slices,
    word_spans,
)
from meterline.llm.components import components

#: Rows and n-grams that one block of a cluster holds at most; a larger row is a block alone.
BLOCK_ROWS, BLOCK_GRAMS = 512, 1 << 19
#: Columns that a product of panels takes at a time, and products that are added up singly at a time.
BLOCK_COLUMNS, BLOCK_PRODUCTS = 4096, 1 << 20
#: A column in one of so many rows or more is multiplied in a panel.
PANEL_SHARE = 8
#: Counters of column frequencies, and how many of them are one row of the counts.
COUNTERS, COUNTERS_IN_ROW = 1 << 20, 1 << 10
#: Bits of a sketch for each n-gram that a linked set may lack, and the least and most bits of one.
SKETCH_SHARE, LEAST_BITS, MOST_BITS = 4, 64, 8192
#: Sets of a column, less those that are joined already, whose pairs are listed; of more, all fall into one cluster.
LISTED = 128
#: Bits that document ids are hashed to, to leave out most texts that no cluster needs before they are dealt out.
MARKS = 1 << 24
#: Columns that a task counts, or first columns that it hands over, at a time.
HELD_GRAMS = 1 << 17

_U = np.uint64


def gram_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's n-grams of lower-cased words."""
    for _, data, bounds in text_slices(texts):
        data = LOWER[data]
        starts, ends, owner = word_spans(data, bounds)
        words = span_hashes(data, starts, ends)
        grams, first = gram_hashes(words, owner, n)
        counts = np.bincount(owner, minlength=len(bounds) - 1)
        at = np.searchsorted(first, np.concatenate(([0], np.cumsum(counts))))
        word_at = np.concatenate(([0], np.cumsum(counts)))
        for i, count in enumerate(counts):
            if 0 < count < n:
                whole, _ = gram_hashes(words[word_at[i] : word_at[i + 1]], owner[word_at[i] : word_at[i + 1]], count)
                yield mix(whole + _U(count))
            else:
                yield np.unique(grams[at[i] : at[i + 1]])


def counters(grams: np.ndarray) -> np.ndarray:
    """The counter of each n-gram."""
    return ((grams >> _U(24)) % _U(COUNTERS)).astype(np.int64)


def lacking(size: int, percent: int) -> int:
    """How many n-grams of a set may be missing from a set linked with it."""
    return size * (100 - percent) // 100


def first_columns(grams: np.ndarray, level: np.ndarray, percent: int) -> np.ndarray:
    """The n-grams that a set gives: those of low counters first, ties by hash."""
    given = min(len(grams), 2 * lacking(len(grams), percent) + 1)
    return grams[np.argsort(level[counters(grams)], kind="stable")[:given]]


def left_out(size: Column, percent: int) -> Column:
    """How many of the columns that a set gives, the most frequent ones, need not be looked at."""
    least = F.ceil(size * percent / F.lit(100))
    lacks = F.floor(least * (100 - percent) / F.lit(100))
    return F.least(least, 2 * lacks + 1) - lacks - 1


def size_classes(sizes: np.ndarray, percent: int) -> np.ndarray:
    """Classes of size; two linked sets are of one class or of two that follow one another."""
    bounds, most = [1], max(sizes, default=0)
    while bounds[-1] <= most:
        bounds.append(bounds[-1] * 100 // percent + 1)  # the least size too large for the one before
    return np.searchsorted(np.array(bounds, np.int64), sizes, "right").astype(np.int32)


def sketch(grams: np.ndarray, percent: int) -> bytes:
    """A power of two of bits, each n-gram flips one; the halves of a sketch make the one half as long."""
    bits = 1 << max(SKETCH_SHARE * lacking(len(grams), percent) - 1, 0).bit_length()
    bits = min(max(bits, LEAST_BITS), MOST_BITS)
    flips = np.bincount((grams & _U(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((flips & 1).astype(bool), bitorder="little").tobytes()


def levels(counts: np.ndarray) -> np.ndarray:
    """The order of counters: the binary logarithm of their share of all, from four times the mean."""
    mean = max(counts.sum() / len(counts), 1)
    return np.log2(np.maximum(counts / (4 * mean), 1)).astype(np.uint8)


def _identity(grams: np.ndarray) -> tuple[int, int]:
    one, two = mix(grams ^ _U(0x1234567)).sum(), mix(grams ^ _U(0x7654321)).sum()
    return tuple(mix(np.array([one, two], _U) + _U(len(grams))).view(np.int64).tolist())


SETS = (
    "doc_id {id}, row_1 bigint, row_2 bigint, n_shingles bigint, set_1 bigint, set_2 bigint, "
    "size_class int, sketch binary"
)
COUNTS = "slice int, counts binary"


def _sets(n: int, percent: int = 80):
    """Size, identity and sketch of each row's set, and after them the counts of their columns.

    Equal sets of a batch are counted once. The rows of counts have no other value.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, schema = np.zeros(COUNTERS, np.int64), None
        names = ["doc_id", "row_1", "row_2", "n_shingles", "set_1", "set_2"]
        names += ["size_class", "sketch", "slice", "counts"]
        for batch in batches:
            size, ids, sketches, seen, held, n_held = [], [], [], set(), [], 0
            for grams in gram_sets(batch.column(1), n):
                size.append(len(grams))
                ids.append(_identity(grams) if len(grams) else (None, None))
                sketches.append(sketch(grams, percent) if len(grams) else None)
                if len(grams) and ids[-1] not in seen:
                    seen.add(ids[-1])
                    held.append(counters(grams))
                    n_held += len(grams)
                if n_held > HELD_GRAMS:
                    np.add.at(total, np.concatenate(held), 1)
                    held, n_held = [], 0
            if held:
                np.add.at(total, np.concatenate(held), 1)
            columns = [batch.column(0), batch.column(2), batch.column(3), pa.array(size, pa.int64())]
            columns += [pa.array([pair[i] for pair in ids], pa.int64()) for i in (0, 1)]
            columns += [pa.array(size_classes(size, percent), pa.int32()), pa.array(sketches, pa.binary())]
            columns += [pa.nulls(len(size), pa.int32()), pa.nulls(len(size), pa.binary())]
            schema = pa.schema([pa.field(name, c.type) for name, c in zip(names, columns, strict=True)])
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
        if total.any():
            slices = _slices(total)
            empty = [pa.nulls(slices.num_rows, field.type) for field in schema][:-2]
            yield pa.RecordBatch.from_arrays([*empty, *slices.columns], schema=schema)

    return run


def _slices(total: np.ndarray) -> pa.RecordBatch:
    parts = total.reshape(-1, COUNTERS_IN_ROW)
    some = np.flatnonzero(parts.any(axis=1))
    columns = [pa.array(some.astype(np.int32)), pa.array([parts[i].tobytes() for i in some], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["slice", "counts"])


def _sum_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of the counts of a task's rows; no more than the counters are held."""
    total = np.zeros((COUNTERS // COUNTERS_IN_ROW, COUNTERS_IN_ROW), np.int64)
    for batch in batches:
        for at, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            total[at] += np.frombuffer(counts.as_buffer(), np.int64)
    if total.any():
        yield _slices(total)


def column_counts(counts: DataFrame) -> np.ndarray:
    """All counters; the driver gets as many numbers as there are counters, whatever the input."""
    slices = counts.mapInArrow(_sum_counts, COUNTS).repartition("slice").mapInArrow(_sum_counts, COUNTS)
    total = np.zeros((COUNTERS // COUNTERS_IN_ROW, COUNTERS_IN_ROW), np.int64)
    for row in slices.collect():
        total[row["slice"]] = np.frombuffer(row["counts"], np.int64)
    return total.ravel()


def _first_columns(n: int, percent: int, level: np.ndarray):
    """The columns that each set gives, once for equal sets of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, node, found, held = set(), [], [], 0
            for grams in gram_sets(batch.column(0), n):
                identity = _identity(grams) if len(grams) else None
                if not identity or identity in seen:
                    continue
                seen.add(identity)
                found.append(first_columns(grams, level, percent))
                node.append(np.full(len(found[-1]), identity[0]))
                held += len(found[-1])
                if held > HELD_GRAMS:
                    yield _written(node, found)
                    node, found, held = [], [], 0
            if held:
                yield _written(node, found)

    return run


def _written(node: list[np.ndarray], found: list[np.ndarray]) -> pa.RecordBatch:
    columns = [pa.array(np.concatenate(node)), pa.array(np.concatenate(found).view(np.int64))]
    return pa.RecordBatch.from_arrays(columns, ["node", "gram"])


def _grams(n: int):
    """The n-grams of each set, once for equal sets of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = {_identity(g): g for g in gram_sets(batch.column(0), n) if len(g)}
            columns = [pa.array([pair[i] for pair in sets], pa.int64()) for i in (0, 1)]
            columns.append(pa.array([g.view(np.int64) for g in sets.values()], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, ["set_1", "set_2", "grams"])

    return run


class Incidence:
    """The rows of each column that several sets have, columns of few rows first."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = len(sets)
        rows = np.repeat(np.arange(self.n), [len(s) for s in sets])
        _, columns, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = counts[columns] > 1
        #: For each row, its columns that no other row has.
        self.alone = np.bincount(rows[~shared], minlength=self.n)
        at = np.empty(len(counts), np.int64)
        at[np.argsort(counts, kind="stable")] = np.arange(len(counts)) - np.count_nonzero(counts == 1)
        order = np.argsort(at[columns[shared]], kind="stable")
        self.rows = rows[shared][order]
        self.counts = np.sort(counts[counts > 1])
        self.starts = np.concatenate(([0], np.cumsum(self.counts)))

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The rows with an entry in each block of columns, and the overlaps of all rows in it."""
        narrow = int(np.searchsorted(self.counts * PANEL_SHARE, self.n))
        products, begin = np.cumsum(self.counts[:narrow] ** 2), 0
        while begin < narrow:
            done = products[begin - 1] if begin else 0
            end = max(int(np.searchsorted(products, done + BLOCK_PRODUCTS, "right")), begin + 1)
            yield self._products(begin, end)
            begin = end
        for begin in range(narrow, len(self.counts), BLOCK_COLUMNS):
            yield self._panel(begin, min(begin + BLOCK_COLUMNS, len(self.counts)))

    def _products(self, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        rows, counts = self.rows[self.starts[begin] : self.starts[end]], self.counts[begin:end]
        times = np.repeat(counts, counts)  # each entry meets all of its column
        first = np.repeat(self.starts[begin:end] - self.starts[begin], counts)
        within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        pairs = np.repeat(rows, times) * self.n + rows[np.repeat(first, times) + within]
        return rows, np.bincount(pairs, minlength=self.n**2).reshape(self.n, self.n)

    def _panel(self, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        rows = self.rows[self.starts[begin] : self.starts[end]]
        panel = np.zeros((self.n, end - begin), np.float32)
        panel[rows, np.repeat(np.arange(end - begin), self.counts[begin:end])] = 1
        return rows, (panel @ panel.T).astype(np.int64)


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """The matrix that says which pairs of sets reach the similarity."""
    size = np.array([len(s) for s in sets], np.int64)
    needed = -(-percent * (size[:, None] + size[None, :]) // (100 + percent))
    matrix = Incidence(sets)
    left = size - matrix.alone
    alive = np.minimum(left[:, None], left[None, :]) >= needed
    overlap = np.zeros(needed.shape, np.int64)
    for rows, found in matrix.blocks():
        overlap += found
        left -= np.bincount(rows, minlength=len(sets))
        alive &= overlap + np.minimum(left[:, None], left[None, :]) >= needed
        if np.count_nonzero(alive) == np.count_nonzero(alive.diagonal()):  # none but with itself
            break
    np.fill_diagonal(alive, True)
    return alive


def _roots(links: np.ndarray) -> np.ndarray:
    """The least index that each index reaches."""
    root = np.arange(len(links))
    while True:
        least = np.where(links, root[None, :], len(links)).min(axis=1)
        least = least[least]
        if (least == root).all():
            return root
        root = least


def _products(percent: int):
    """Links within each cell of rows; the rows of a cell follow one another."""

    def cell(ids: list[tuple[int, int]], sets: list[np.ndarray]) -> list[tuple[int, ...]]:
        root = _roots(linked(sets, percent))
        return [(*ids[i], *ids[r]) for i, r in enumerate(root) if r != i]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets = None, [], []
        for batch in batches:
            found = []
            cells = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            names = zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)
            bounds = batch.column(5).offsets.to_numpy()
            values = batch.column(5).values.to_numpy().view(_U)
            for i, (at, name) in enumerate(zip(cells, names, strict=True)):
                if at != key:
                    if len(sets) > 1:
                        found += cell(ids, sets)
                    key, ids, sets = at, [], []
                ids.append(name)
                sets.append(values[bounds[i] : bounds[i + 1]].copy())
            yield _edges(found)
        if len(sets) > 1:
            yield _edges(cell(ids, sets))

    return run


def _edges(found: list[tuple[int, ...]]) -> pa.RecordBatch:
    columns = [pa.array([row[i] for row in found], pa.int64()) for i in range(4)]
    return pa.RecordBatch.from_arrays(columns, ["a_1", "a_2", "b_1", "b_2"])


def _near_enough(one: Column, other: Column, percent: int) -> Column:
    return F.least(one, other) * 100 >= F.greatest(one, other) * percent


def _bytes(column: pa.Array, rows: np.ndarray, length: int, wanted: int) -> np.ndarray:
    """Sketches of one length, a row each, folded to the wanted length."""
    taken = column.take(pa.array(rows))
    start = taken.offset * length
    found = np.frombuffer(taken.buffers()[2], np.uint8)[start : start + len(rows) * length].reshape(len(rows), length)
    while length > wanted:
        length //= 2
        found = found[:, :length] ^ found[:, length:]
    return np.ascontiguousarray(found)


def unlike(one: pa.Array, other: pa.Array) -> np.ndarray:
    """How many n-grams at least are in one set of each pair of sketches only."""
    long = [np.diff(np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]) for c in (one, other)]
    found = np.zeros(len(one), np.int64)
    for lengths in set(zip(*(x.tolist() for x in long), strict=True)):
        rows = np.flatnonzero((long[0] == lengths[0]) & (long[1] == lengths[1]))
        sketches = (_bytes(c, rows, length, min(lengths)) for c, length in zip((one, other), lengths, strict=True))
        found[rows] = np.bitwise_count(np.bitwise_xor(*sketches).view(np.uint64)).sum(axis=1)
    return found


def _alike(percent: int):
    """The pairs whose sketches allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            needed = -(-percent * sizes // (100 + percent))
            near = unlike(batch.column(4), batch.column(5)) <= sizes - 2 * needed
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(near)) for i in (0, 1)], ["a", "b"])

    return run


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sketches allow the similarity."""
    for x in ("a", "b"):
        known = sets.select(F.col("set_1").alias(x), F.col("n_shingles").alias(f"size_{x}"), F.col("sketch").alias(f"sketch_{x}"))
        pairs = pairs.join(known.hint("merge"), x)
    pairs = pairs.select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b")
    return pairs.mapInArrow(_alike(percent), "a bigint, b bigint")


def _shared(texts: DataFrame, sets: DataFrame, n: int, percent: int, counts: np.ndarray) -> DataFrame:
    """Sets by column looked at and class of size, where there are two at least; the hub is the least of them.

    A set comes in its own class and in the next, where it meets the sets of that one.
    """
    given = texts.mapInArrow(_first_columns(n, percent, levels(counts)), "node bigint, gram bigint")
    given = given.withColumn("n_sets", F.count("*").over(Window.partitionBy("gram"))).filter("n_sets > 1")
    skip = left_out(F.col("n_shingles"), percent).alias("skip")
    known = sets.select(F.col("set_1").alias("node"), F.col("n_shingles").alias("size"), "size_class", skip)
    # Copies of a set in other batches have equal ranks.
    falling = Window.partitionBy("node").orderBy(F.desc("n_sets"), F.desc("gram"))
    ranked = given.join(known.hint("merge"), "node").withColumn("rank", F.dense_rank().over(falling))
    looked_at = ranked.filter("rank > skip").select("gram", "node", "size", "size_class").distinct()
    placed = looked_at.withColumn("class", F.explode(F.array("size_class", F.col("size_class") + 1)))
    placed = placed.withColumn("own", F.expr("class = size_class")).drop("size_class")
    together = Window.partitionBy("gram", "class")
    for name, value in (
        ("hub", F.min(F.struct("node", "size"))), ("last", F.max("node")), ("some", F.max("own"))
    ):
        placed = placed.withColumn(name, value.over(together))
    return placed.filter("some and last > hub.node and node > hub.node").drop("last", "some")


def _clusters(texts: DataFrame, sets: DataFrame, n: int, percent: int, counts: np.ndarray) -> DataFrame:
    """(node, component) for sets that are alike by sketches, directly or by others, and share a column."""
    shared = stored(_shared(texts, sets, n, percent, counts), "gram-shared")
    near = _near_enough(F.col("size"), F.col("hub.size"), percent)
    stars = shared.filter(near).select(F.col("node").alias("a"), F.col("hub.node").alias("b")).distinct()
    joined = stored(components(_compared(stars, sets, percent)), "gram-joined")

    # What is left are pairs that are not of the hub, of sets that are not joined yet.
    left = shared.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    together = Window.partitionBy("gram", "class")
    for name, value in (("least", F.min("component")), ("most", F.max("component")), ("rows", F.count("*"))):
        left = left.withColumn(name, value.over(together))
    left = stored(left.filter("least < most").drop("least", "most"), "gram-left")
    one, other = left.filter(F.col("rows") <= LISTED).alias("x"), left.filter(F.col("rows") <= LISTED).alias("y")
    pairs = one.join(other.hint("merge"), ["gram", "class"]).filter(
        "x.node < y.node and x.component != y.component and (x.own or y.own)"
    )
    pairs = pairs.filter(_near_enough(F.col("x.size"), F.col("y.size"), percent))
    pairs = pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    crowded = left.filter(F.col("rows") > LISTED).select(F.col("node").alias("a"), F.col("hub.node").alias("b"))
    known = joined.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return components(known.union(_compared(pairs, sets, percent)).union(crowded))


def _place(doc_id: str) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(MARKS)).alias("place")


def _marks(wanted: DataFrame) -> np.ndarray:
    """A bit for each place of a wanted document; the driver gets no more bits, whatever the input."""
    bits = wanted.select(_place("wanted")).groupBy(F.expr("place div 64").alias("word"))
    found = bits.agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 AS int))")).alias("bits")).toArrow()
    marks = np.zeros(MARKS // 64, np.uint64)
    marks[found.column(0).to_numpy()] = found.column(1).to_numpy().view(np.uint64)
    return marks


def _marked(marks: np.ndarray):
    """The rows whose place is marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(0).to_numpy()
            some = (marks[place >> 6] >> (place & 63).astype(_U)) & _U(1)
            yield batch.filter(pa.array(some.astype(bool)))

    return run


GRAMS = "set_1 bigint, set_2 bigint, grams array<bigint>"


def _multiplied(members: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """Edges that span the linked pairs of each cluster."""
    sizes = members.groupBy("component").agg(F.count("*").alias("rows"), F.sum("n_shingles").alias("grams"))
    by_rows, by_grams = F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("grams") / BLOCK_GRAMS)
    blocks = sizes.select("component", F.greatest(by_rows, by_grams).alias("blocks"))
    placed = members.join(blocks, "component").withColumn("block", F.pmod("set_2", "blocks"))
    # Copies in other batches are dropped; the join needs the same exchange.
    grams = grams.groupBy("set_1", "set_2").agg(F.first("grams").alias("grams")).hint("merge")
    cells = placed.join(grams, ["set_1", "set_2"]).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    key = ("component", "row", "column")
    cells = cells.select(
        "component",
        F.least("block", "other").alias("row"),
        F.greatest("block", "other").alias("column"),
        "set_1", "set_2", "grams",
    )
    cells = cells.repartition(*key).sortWithinPartitions(*key)
    links = cells.mapInArrow(_products(percent), "a_1 bigint, a_2 bigint, b_1 bigint, b_2 bigint")
    pair = lambda x: F.struct(F.col(f"{x}_1").alias("set_1"), F.col(f"{x}_2").alias("set_2")).alias(x)
    return links.select(pair("a"), pair("b"))


def _row_key(doc_id: Column, text: Column) -> list[Column]:
    return [F.xxhash64(doc_id, text).alias("row_1"), F.xxhash64(text, doc_id).alias("row_2")]


def _grouped(docs: DataFrame, n: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """A row for each document with the least set and the least document id of its component."""
    ids, texts = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    rows = docs.select(ids.alias("doc_id"), texts.alias("text"), *_row_key(ids, texts))
    kind = rows.schema["doc_id"].dataType.simpleString()
    written = stored(rows.mapInArrow(_sets(n, percent), f"{SETS.format(id=kind)}, {COUNTS}"), "gram-sets")
    counts = column_counts(written.filter("slice IS NOT NULL").select("slice", "counts"))
    every = written.filter("slice IS NULL").drop("slice", "counts")
    found = every.filter("n_shingles > 0")
    # One row for each set, however many copies there are.
    same = [F.first(name).alias(name) for name in ("n_shingles", "size_class", "sketch")]
    sets = found.groupBy("set_1", "set_2").agg(F.min("doc_id").alias("doc_id"), *same)
    sets = stored(sets, "gram-distinct")
    clusters = stored(_clusters(rows.select("text"), sets, n, percent, counts), "gram-clusters")
    members = sets.drop("size_class", "sketch").join(clusters, sets.set_1 == clusters.node).drop("node")
    members = stored(members, "gram-members")
    # Merged at every size, so that the plan on a small table is the plan on a large one.
    wanted = members.select("doc_id").distinct().withColumnRenamed("doc_id", "wanted").hint("merge")
    # The marks leave few texts besides; the join is exact.
    placed = rows.select(_place("doc_id"), "doc_id", "text")
    marked = placed.mapInArrow(_marked(_marks(wanted)), placed.schema)
    texts = marked.join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi").select("text")
    whole = texts.mapInArrow(_grams(n), GRAMS)
    joined = components(_multiplied(members, whole, percent))

    named = sets.select("set_1", "set_2", "doc_id").join(
        joined.select("node.set_1", "node.set_2", "component"), ["set_1", "set_2"], "left"
    )
    named = named.withColumn("component", F.coalesce("component", F.struct("set_1", "set_2")))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "component").select("set_1", "set_2", "component", "component_id")
    return every.select("doc_id", "n_shingles", "row_1", "row_2", "set_1", "set_2").join(
        named, ["set_1", "set_2"], "left"
    )


def near_duplicates(
    docs: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` for each row.

    The component holds all documents reachable by links of at least ``percent`` similarity
    and is named by its least document id.
    """
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    found = _grouped(docs, n, percent, doc_id, text)
    return found.select("doc_id", "n_shingles", component.alias("component_id"))


def keep_one(
    docs: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row of each component, that of the least document id, and all rows without words.

    Columns are unchanged.
    """
    found = _grouped(docs, n, percent, doc_id, text)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_1", "row_2")).alias("first")
    kept = found.filter("n_shingles > 0").groupBy("component").agg(first)
    kept = kept.select("first.row_1", "first.row_2", F.lit(True).alias("alone"))
    wordless = found.filter("n_shingles = 0").select("row_1", "row_2", F.lit(False).alias("alone")).distinct()
    names = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(F.struct(*names).alias("row"), *_row_key(F.col(f"`{doc_id}`"), F.col(f"`{text}`")))
    joined = keyed.join(kept.union(wordless), ["row_1", "row_2"])
    same = Window.partitionBy("row_1", "row_2").orderBy("alone")  # equal rows, of which one stays
    chosen = joined.withColumn("copy", F.row_number().over(same)).filter("copy = 1 or not alone")
    return chosen.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op4_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), n=3, percent=90)
