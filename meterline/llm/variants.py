"""Grouping of spelling variants: words one edit apart, found through k-d trees over letter counts.

Words are counted first; the search works on the vocabulary. One inserted, deleted or replaced
letter changes the vector of a word's letter counts by one up, one down, or one of both, an L1
distance of two at most, so for each pair of lengths a range search in a k-d tree finds all
candidates: a branch is left as soon as its box is further from the query than that, above and
below counted apart. What remains is verified letter by letter.

The upper levels of the trees, one for each length, are fitted on a bounded sample of words
(``SAMPLE``); they only say which cells there are. Every word lies in one cell as a point and
is sent as a query to each cell whose box its neighbours may lie in. A cell with more points or
queries than a task should hold is dealt into blocks that all meet. In a cell the points are
indexed by a tree of their own.

Defined results: a null or empty text has no words; a null id is hashed as no digits; rows
equal in id and text count as often as they occur; words are counted over whole texts and may
have any length; ties of the largest neighbour go to the word that is smallest in code-point
order; an empty table gives no words. Only the columns of id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.llm.common import stored, table

MIN_LETTERS = 7
MIN_COUNT = 2
#: A form occurs at least this many times as often as its variant.
RATIO = 10
#: One of so many runs loses a letter.
LOSES = 31
#: Words that the upper levels of the trees are fitted on, and the most that are collected.
SAMPLE = 1 << 16
#: Words, and bytes of their letters and counts, that one side of a block should have.
BLOCK_WORDS = 1 << 15
BLOCK_BYTES = 32 << 20
LEAF = 64
#: Letters compared at a time.
COMPARED = 1 << 23

# The letters, a to z and U+00C0 to U+00FF, and the capitals that are lower-cased.
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTER = "[A-Za-zÀ-ÿ]"
N_LETTERS = 26 + 64
_NUMBER = np.zeros(256, np.uint8)
_NUMBER[0x61:0x7B] = np.arange(26)
_NUMBER[0xC0:0x100] = np.arange(26, N_LETTERS)


def counted_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): runs of letters, some of which lose one letter, counted over all texts.

    Tasks count their own words before the shuffle, so a frequent word is one row for each.
    """
    runs = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"{LETTER}{{{MIN_LETTERS},}}"), F.lit(0))
    ids = F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))
    run = docs.select(ids.alias("id"), F.explode(runs).alias("run"))
    lower = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", CAPITALS, SMALL)).otherwise(F.col("run"))
    run = run.select("id", lower.alias("run"))
    hashed = run.withColumn("h", F.crc32(F.concat_ws(":", "id", "run")))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("h") % LOSES == 0, shorter).otherwise(F.col("run"))
    counted = hashed.select(word.alias("word")).filter(F.length("word") >= MIN_LETTERS).groupBy("word")
    return counted.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_COUNT)


# ---------------------------------------------------------------- words as arrays


def letters(words: list[str]) -> np.ndarray:
    """Words of one length as rows of letter numbers, which are in code-point order."""
    data = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    return _NUMBER[data].reshape(len(words), -1)


def letter_counts(rows: np.ndarray) -> np.ndarray:
    """How often each letter occurs in each row."""
    kind = np.uint8 if rows.shape[1] < 256 else np.int32
    found = np.zeros((len(rows), N_LETTERS), kind)
    every = np.arange(len(rows))
    for column in rows.T:
        found[every, column] += 1
    return found


# ---------------------------------------------------------------- k-d trees


@dataclass(frozen=True)
class Tree:
    """Nodes split a letter's count: up to ``cut`` to the left. A leaf has a negative letter and its number as cut."""

    letter: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    n_leaves: int

    @staticmethod
    def fit(points: np.ndarray, leaf: float) -> tuple[Tree, list[np.ndarray]]:
        """A tree whose leaves have up to ``leaf`` of these points, and the points of each leaf.

        Each node takes the letter whose count, cut at its mean, divides the points best;
        points that are all alike stay together.
        """
        nodes: list[list[int]] = [[-1, 0, -1, -1]]
        leaves, todo = [], [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if len(rows) > leaf:
                own = points[rows]
                cut = own.mean(axis=0).astype(points.dtype)
                below = np.count_nonzero(own <= cut, axis=0)
                letter = int(np.abs(below - len(rows) / 2).argmin())
                if below[letter] < len(rows):
                    low = own[:, letter] <= cut[letter]
                    nodes[node] = [letter, int(cut[letter]), len(nodes), len(nodes) + 1]
                    nodes += [[-1, 0, -1, -1], [-1, 0, -1, -1]]
                    todo += [(len(nodes) - 2, rows[low]), (len(nodes) - 1, rows[~low])]
                    continue
            nodes[node][1] = len(leaves)
            leaves.append(rows)
        return Tree(*np.array(nodes, np.int32).T, len(leaves)), leaves

    def place(self, points: np.ndarray) -> np.ndarray:
        """The leaf that each point lies in."""
        at = np.zeros(len(points), np.int32)
        busy = np.flatnonzero(self.letter[at] >= 0)
        while len(busy):
            node = at[busy]
            low = points[busy, self.letter[node]] <= self.cut[node]
            at[busy] = np.where(low, self.left[node], self.right[node])
            busy = busy[self.letter[at[busy]] >= 0]
        return self.cut[at]

    def near(self, queries: np.ndarray, replaced: bool) -> Iterator[tuple[int, np.ndarray]]:
        """For each leaf the queries that a point in its box may be one edit from.

        The point has one letter more than the query, or with ``replaced`` a later letter in
        place of an earlier one, so that of two words only the lesser is a query.
        """
        rows, none = np.arange(len(queries)), np.full(len(queries), -1, np.int16)
        # Letters that the box forces up or down; -1 is none so far.
        todo = [(0, rows, none, none)]
        while todo:
            node, rows, up, down = todo.pop()
            letter, cut = int(self.letter[node]), int(self.cut[node])
            if letter < 0:
                yield cut, rows
                continue
            have = queries[rows, letter].astype(np.int32)
            # Left: at most `cut`. A query above it must lose one of this letter, once.
            over = have - cut
            ok = over <= 0
            if replaced:
                may = (over == 1) & ((down == letter) | (down < 0)) & ((up < 0) | (up > letter))
                new = np.where(may, np.int16(letter), down)
                ok |= may
            else:
                new = down
            if ok.any():
                todo.append((int(self.left[node]), rows[ok], up[ok], new[ok]))
            # Right: more than `cut`. A query below it must gain one of this letter, once.
            under = cut + 1 - have
            may = (under == 1) & ((up == letter) | (up < 0))
            if replaced:
                may &= (down < 0) | (down < letter)
            new = np.where(may, np.int16(letter), up)
            ok = (under <= 0) | may
            if ok.any():
                todo.append((int(self.right[node]), rows[ok], new[ok], down[ok]))


def _packed(rows: np.ndarray) -> np.ndarray:
    """Letter numbers, which are below 128, eight to a value."""
    width = -(-rows.shape[1] // 8)
    padded = np.zeros((len(rows), 8 * width), np.uint8)
    padded[:, : rows.shape[1]] = rows
    return padded.view(np.uint64)


_SEVENS, _TOPS = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)


class _Words:
    """Words of one length in the forms that are compared."""

    def __init__(self, words: list[str]):
        self.letters = letters(words)
        self.counts = letter_counts(self.letters)
        self.packed = _packed(self.letters)
        wide = self.letters.astype(np.int64)
        self.sums, self.squares = wide.sum(axis=1), (wide * wide).sum(axis=1)

    def replaced(self, rows: np.ndarray, points: _Words, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that differ in one place, where the point has the later letter."""
        n = np.zeros((len(rows), len(others)), np.uint8)
        for k in range(self.packed.shape[1]):
            differs = self.packed[rows, k][:, None] ^ points.packed[others, k][None, :]
            n = np.minimum(n + np.bitwise_count((differs + _SEVENS) & _TOPS), 2)
        q, p = np.nonzero(n == 1)
        q, p = rows[q], others[p]
        later = points.sums[p] > self.sums[q]
        return q[later], p[later]

    def inserted(self, rows: np.ndarray, points: _Words, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of which the point has one letter more: what agrees from either end covers the query.

        The letter that comes in is the difference of the sums, and its square that of the squares.
        """
        letter = points.sums[others][None, :] - self.sums[rows][:, None]
        q, p = np.nonzero(points.squares[others][None, :] - self.squares[rows][:, None] == letter * letter)
        q, p = rows[q], others[p]
        query, point, size = self.letters[q], points.letters[p], self.letters.shape[1]
        front = np.logical_and.accumulate(query == point[:, :size], axis=1).sum(axis=1)
        back = np.logical_and.accumulate((query == point[:, 1:])[:, ::-1], axis=1).sum(axis=1)
        near = front + back >= size
        return q[near], p[near]


class Index:
    """Words of one length in a tree."""

    def __init__(self, points: list[str]):
        self.points = _Words(points)
        self.tree, self.leaves = Tree.fit(self.points.counts, LEAF)

    def near(self, queries: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, point) one edit apart. All queries have the length of the points, or one less."""
        found = [(np.zeros(0, np.int64),) * 2]
        asked = _Words(queries)
        length = self.points.letters.shape[1]
        replaced = asked.letters.shape[1] == length
        compare = asked.replaced if replaced else asked.inserted
        for leaf, rows in self.tree.near(asked.counts, replaced):
            own = self.leaves[leaf]
            # Points that are all alike in their letters may be many in one leaf.
            for b in range(0, len(own), 4096):
                some = own[b : b + 4096]
                step = max(1, COMPARED // (len(some) * length))
                found += [compare(rows[a : a + step], self.points, some) for a in range(0, len(rows), step)]
        return tuple(np.concatenate(parts) for parts in zip(*found, strict=True))


# ---------------------------------------------------------------- the vocabulary in cells


def _capacity(length: int) -> int:
    return max(1, min(BLOCK_WORDS, BLOCK_BYTES // (length + 4 * N_LETTERS)))


def fitted_trees(words: DataFrame) -> dict[int, tuple[int, Tree]]:
    """For each length of the sample the number of its first cell and its tree.

    The sample has the words of least hash, ``SAMPLE`` at most; how many words there are is counted.
    """
    total = words.count()
    sample = words.select("word").orderBy(F.xxhash64("word"), "word").limit(SAMPLE).toArrow().column(0).to_pylist()
    by_length: dict[int, list[str]] = {}
    for word in sample:
        by_length.setdefault(len(word), []).append(word)
    trees, first = {}, 0
    for length, some in sorted(by_length.items()):
        share = total / len(sample)
        tree, _ = Tree.fit(letter_counts(letters(some)), max(1.0, _capacity(length) / share))
        trees[length] = (first, tree)
        first += tree.n_leaves
    return trees


_ROUTED = "cell int, length int, query int, word string, n bigint"
_WHOLE = Tree(*(np.array([x], np.int32) for x in (-1, 0, -1, -1)), 1)


def _route(trees: dict[int, tuple[int, Tree]]):
    """Each word as a point in its cell (query 0), and as a query for points as long (1) and longer by one (2).

    A length without a tree has one cell, whose number is -1; cells of different lengths differ by the length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            length = np.array([len(w) for w in words], np.int64)
            for size in np.unique(length).tolist():
                rows = np.flatnonzero(length == size)
                points = letter_counts(letters([words[i] for i in rows.tolist()]))
                parts = []
                for query, of in ((0, size), (1, size), (2, size + 1)):
                    first, tree = trees.get(of, (-1, _WHOLE))
                    if query:
                        found = list(tree.near(points, query == 1))
                    else:
                        found = [(tree.place(points), np.arange(len(rows)))]
                    for cell, at in found:
                        cells = np.broadcast_to(np.int32(first) + cell, at.shape).astype(np.int32)
                        parts.append((cells, np.full(len(at), of, np.int32), np.full(len(at), query, np.int32), rows[at]))
                cell, of, query, at = (np.concatenate(x) for x in zip(*parts, strict=True))
                columns = [pa.array(cell), pa.array(of), pa.array(query), batch.column(0).take(pa.array(at)), pa.array(counts[at])]
                names = ["cell", "length", "query", "word", "n"]
                for start in range(0, len(at), 1 << 16):
                    yield pa.RecordBatch.from_arrays([c.slice(start, 1 << 16) for c in columns], names)

    return run


_PAIRS = "word string, n bigint, other string, other_n bigint"


def _meet(key: tuple, rows: pa.Table) -> pa.Table:
    """Near pairs of the queries and points of one block."""
    role, words, n = rows["query"].to_numpy(), rows["word"].combine_chunks(), rows["n"].to_numpy()
    points = np.flatnonzero(role == 0)
    found = [(np.zeros(0, np.int64),) * 2]
    index = Index(words.take(pa.array(points)).to_pylist()) if len(points) else None
    for query in (1, 2):
        asking = np.flatnonzero(role == query)
        if index and len(asking):
            q, p = index.near(words.take(pa.array(asking)).to_pylist())
            found.append((asking[q], points[p]))
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    columns = [words.take(pa.array(a)), pa.array(n[a]), words.take(pa.array(b)), pa.array(n[b])]
    return pa.table([columns[0].cast(pa.string()), columns[1], columns[2].cast(pa.string()), columns[3]], ["word", "n", "other", "other_n"])


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): each pair of different words one edit apart, once. ``words`` is read several times."""
    routed = words.select("word", "n").mapInArrow(_route(fitted_trees(words)), _ROUTED)
    sizes = routed.groupBy("cell", "length").agg(
        F.count_if(F.col("query") == 0).alias("points"), F.count_if(F.col("query") > 0).alias("queries")
    )
    held = F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(BLOCK_BYTES / (F.col("length") + 4 * N_LETTERS))))
    blocks = sizes.select(
        "cell",
        "length",
        F.ceil(F.col("points") / held).cast("int").alias("point_blocks"),
        F.ceil(F.col("queries") / held).cast("int").alias("query_blocks"),
    ).filter("point_blocks > 0 and query_blocks > 0")
    dealt = routed.join(blocks, ["cell", "length"])
    is_point = F.col("query") == 0
    own = lambda n: F.array(F.pmod(F.xxhash64("word"), n).cast("int"))
    every = lambda n: F.sequence(F.lit(0), n - 1)
    point = F.when(is_point, own(F.col("point_blocks"))).otherwise(every(F.col("point_blocks")))
    query = F.when(is_point, every(F.col("query_blocks"))).otherwise(own(F.col("query_blocks")))
    copies = dealt.withColumn("point_block", F.explode(point)).withColumn("query_block", F.explode(query))
    return copies.groupBy("cell", "length", "point_block", "query_block").applyInArrow(_meet, _PAIRS)


# ---------------------------------------------------------------- forms


def variant_groups(words: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for the words of a table (word, n) with distinct words.

    A word's form is its near word of largest n, if that is ``RATIO`` times its own; the root is
    the last of the chain of forms. Counts grow along a chain by that factor, so it is short.
    """
    pairs = near_words(words)
    both = pairs.union(pairs.select("other", "other_n", "word", "n"))
    both = stored(both, "near-words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other")))
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = words.join(near, "word", "left")
    large = -F.col("best.less") >= RATIO * F.col("n")
    formed = joined.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(large, F.col("best.other")).alias("form"),
        F.when(large, -F.col("best.less")).alias("form_n"),
    )
    formed = stored(formed, "word-forms")
    links = formed.filter("form is not null").select("word", "form")
    # Each different form once, with the last word found so far; every round doubles the steps taken.
    last = links.select(F.col("form").alias("word")).distinct().join(links, "word", "left")
    last = stored(last.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        ahead = last.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = last.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), (F.col("next") != F.col("root")).alias("moved"))
        further = stored(further, "roots")
        last = further.select("word", "root")
        if further.filter("moved").isEmpty():
            break
    # Words without a form look themselves up, so that no key is shared by all of them.
    ends = last.select(F.col("word").alias("from"), "root")
    rooted = formed.withColumn("from", F.coalesce("form", "word")).join(ends, "from", "left")
    return rooted.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "from").alias("root"))


def op13_variants(spark, sf_dir: str) -> DataFrame:
    words = stored(counted_words(table(spark, sf_dir, "documents")), "words")
    return variant_groups(words).select("word", "n", "n_near", "form", "form_n", "root")
