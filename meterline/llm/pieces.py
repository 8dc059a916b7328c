"""SentencePiece encoding and decoding by suffix-array matching, equal to the library's.

For merge-ranked (BPE) models with byte fallback and identity normalisation. A text becomes
units that begin at a space mark, across which no piece reaches. The units of a batch that are
new to a worker are laid end to end and their suffixes sorted; every piece of the vocabulary
finds its range of occurrences by binary search; the occurrences are edges from a position to
a later one, and are relaxed in the order of their starts. A piece may follow another only if
merging could have left that boundary open, which the two pieces' own merges decide; so each
position keeps the one piece that can end there.

Defined results: null stays null; an empty text has no pieces; characters without a piece are
written as bytes; texts are encoded whole. Decoding gives the text back, but for U+2581, which
the model does not tell from a blank.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.llm.common import mix, table

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNITS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Bytes of text for which a task finds new units at a time; a longer text is handled alone.
BATCH_BYTES = 1 << 21
#: Ids that a task decodes at a time; those of a longer text are decoded alone.
BATCH_IDS = 1 << 18
#: Rows that ``round_trip`` encodes and decodes at a time.
BATCH_ROWS = 1000
#: Units that a worker remembers before it forgets them all.
KNOWN_UNITS = 250_000
#: Bytes of new units in one suffix array.
INDEX_BYTES = 1 << 19
_SEEN_SLOTS = 1 << 20
#: Edges of one depth below which they are relaxed one by one, and how many of them are held as numbers at a time.
FEW_EDGES, EDGE_SLAB = 48, 1 << 17
_NONE = np.iinfo(np.int32).min
_U = np.uint64


@dataclass(frozen=True)
class Vocabulary:
    """The pieces of a model and their scores; control pieces are None."""

    pieces: tuple[str | None, ...]
    scores: tuple[float, ...]
    byte_ids: tuple[int, ...]

    @staticmethod
    @cache
    def load(path: str = MODEL_PATH) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        plain = lambda i: not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
        pieces = tuple(model.id_to_piece(i) if plain(i) else None for i in ids)
        return Vocabulary(pieces, tuple(map(model.get_score, ids)), tuple(i for i in ids if model.is_byte(i)))


class Matcher:
    """Tables of a vocabulary, and the units that this worker has encoded so far."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.id_of = {p: i for i, p in enumerate(vocabulary.pieces) if p}
        n = len(vocabulary.pieces)
        order = sorted(set(vocabulary.scores), reverse=True)
        place = {score: i for i, score in enumerate(order)}
        self.rank = np.array([place[s] for s in vocabulary.scores], np.int64)
        self.bytes = [p.encode() if p else b"" for p in vocabulary.pieces]
        self.length = np.array([len(b) for b in self.bytes], np.int32)
        self.left = np.arange(n)
        self.right = np.arange(n)
        joins = []
        for i, piece in enumerate(vocabulary.pieces):
            if piece and len(piece) > 1:
                joins += self._joins(i, piece)
                self.left[i], self.right[i] = self._last_merge(piece) or (i, i)
        joins.sort()
        self.join_key = np.array([a * n + b for a, b, _ in joins], np.int64)
        self.join_rank = np.array([self.rank[c] for _, _, c in joins], np.int64)
        ids = np.array([i for i, p in enumerate(vocabulary.pieces) if p], np.int32)
        self.search_ids = ids
        width = -(-int(self.length.max()) // 8)
        packed = np.zeros((len(ids), width * 8), np.uint8)
        for row, i in enumerate(ids):
            packed[row, : self.length[i]] = np.frombuffer(self.bytes[i], np.uint8)
        self.search_key = packed.view(">u8").astype(_U).T.copy()
        spare = np.clip(8 * np.arange(1, width + 1)[:, None] - self.length[ids][None, :], 0, 8).astype(_U)
        self.search_mask = np.where(spare == 8, _U(0), ~_U(0) << (spare * _U(8) % _U(64)))
        self.seen_key = np.full(_SEEN_SLOTS, -1, np.int64)
        self.seen_valid = np.zeros(_SEEN_SLOTS, bool)
        self.join_of = dict(zip(self.join_key.tolist(), self.join_rank.tolist(), strict=True))
        self.lists = self.left.tolist(), self.right.tolist(), self.rank.tolist()
        self.pairs: dict[int, bool] = {}
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    def _joins(self, i: int, piece: str) -> list[tuple[int, int, int]]:
        get = self.id_of.get
        cuts = ((get(piece[:k]), get(piece[k:])) for k in range(1, len(piece)))
        return [(a, b, i) for a, b in cuts if a is not None and b is not None]

    def _last_merge(self, piece: str) -> tuple[int, int] | None:
        """The two pieces whose merge completes this one when it is merged alone."""
        parts, last = list(piece), None
        while len(parts) > 1:
            merges = [
                (self.rank[c], k)
                for k in range(len(parts) - 1)
                if (c := self.id_of.get(parts[k] + parts[k + 1])) is not None
            ]
            if not merges:
                return None
            k = min(merges)[1]
            last = self.id_of.get(parts[k]), self.id_of.get(parts[k + 1])
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return last if last and None not in last else None

    # ------------------------------------------------------------ which piece may follow which

    def _open(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Does merging leave the boundary between pieces a and b open?

        The pieces are taken apart from the boundary outwards, the later merge first; the
        boundary closes if a pair across it would have merged before the merge undone last.
        """
        n, one, two = len(self.rank), a.copy(), b.copy()
        limit = np.full(len(a), np.iinfo(np.int64).max)
        valid, busy = np.ones(len(a), bool), np.arange(len(a))
        while len(busy):
            x, y = one[busy], two[busy]
            key = x * n + y
            at = np.minimum(np.searchsorted(self.join_key, key), len(self.join_key) - 1)
            closes = (self.join_key[at] == key) & (self.join_rank[at] < limit[busy])
            valid[busy[closes]] = False
            leaf_x, leaf_y = self.right[x] == x, self.left[y] == y
            take_x = ~leaf_x & (leaf_y | (self.rank[x] > self.rank[y]))
            # Of equal ranks the merge further left comes first.
            limit[busy] = np.where(take_x, self.rank[x], self.rank[y] + 1)
            one[busy] = np.where(take_x, self.right[x], x)
            two[busy] = np.where(take_x, y, self.left[y])
            busy = busy[~closes & ~(leaf_x & leaf_y)]
        return valid

    def _opens(self, a: int, b: int) -> bool:
        """``_open`` for one pair."""
        (left, right, rank), join, n = self.lists, self.join_of.get, len(self.rank)
        limit = math.inf
        while True:
            joined = join(a * n + b)
            if joined is not None and joined < limit:
                return False
            inner_a, inner_b = right[a], left[b]
            if inner_a != a and (inner_b == b or rank[a] > rank[b]):
                limit, a = rank[a], inner_a
            elif inner_b != b:
                limit, b = rank[b] + 1, inner_b
            else:
                return True

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``_open`` with an answer remembered for each pair; a negative piece never merges."""
        key = a.astype(np.int64) * len(self.rank) + b
        slot = (mix(key.astype(_U)) & _U(_SEEN_SLOTS - 1)).astype(np.int64)
        new = (self.seen_key[slot] != key) & (a >= 0) & (b >= 0)
        result = self.seen_valid[slot]
        if new.any():
            pairs, back = np.unique(key[new], return_inverse=True)
            answers = self._open(pairs // len(self.rank), pairs % len(self.rank))
            result[new] = answers[back]
            at = slot[new]
            self.seen_key[at], self.seen_valid[at] = key[new], answers[back]
        return result | (a < 0) | (b < 0)

    # ------------------------------------------------------------ suffix array and edges

    def _suffix_array(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Suffixes that begin a character, sorted as far as pieces reach, and their keys of 8 bytes."""
        width = len(self.search_key)
        padded = np.concatenate((data, np.full(8 * width + 8, 255, np.uint8)))
        words = np.zeros(len(padded) - 7, _U)
        for k in range(8):
            words |= padded[k : len(padded) - 7 + k].astype(_U) << _U(56 - 8 * k)
        order = np.argsort(words[begins], kind="stable")
        sorted_at = begins[order]
        for k in range(1, width):  # only runs of equal keys are sorted further
            key = words[sorted_at + 8 * (k - 1)]
            same = key[1:] == key[:-1]
            if k > 1:
                same &= tied[1:]
            # A run ends where a separator fell within the key: no piece reaches across it.
            tied = np.concatenate(([False], same))
            inside = tied | np.append(tied[1:], False)
            if not inside.any():
                break
            run = np.cumsum(~tied)[inside]
            rows = np.flatnonzero(inside)
            sorted_at[rows] = sorted_at[rows][np.lexsort((words[sorted_at[rows] + 8 * k], run))]
        return sorted_at, words

    def _ranges(self, suffixes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every piece the range of the sorted suffixes that begin with it, by binary search."""
        bounds = [np.zeros(len(self.search_ids), np.int64)]
        for upper in (False, True):
            lo, hi = bounds[-1].copy(), np.full(len(self.search_ids), len(suffixes), np.int64)
            if upper:  # only pieces that occur have more to find
                occurs = lo < len(suffixes)
                at = suffixes[np.minimum(lo, len(suffixes) - 1)]
                for k in range(len(self.search_key)):
                    occurs &= (words[at + 8 * k] & self.search_mask[k]) == self.search_key[k]
                hi = np.where(occurs, hi, lo)
            busy = np.flatnonzero(lo < hi)
            while len(busy):
                mid = (lo[busy] + hi[busy]) // 2
                at = suffixes[mid]
                right, equal = np.zeros(len(busy), bool), np.ones(len(busy), bool)
                for k in range(len(self.search_key)):
                    if not equal.any():
                        break
                    have = words[at + 8 * k] & self.search_mask[k][busy]
                    want = self.search_key[k][busy]
                    right |= equal & (have < want)
                    equal &= have == want
                if upper:
                    right |= equal
                lo[busy] = np.where(right, mid + 1, lo[busy])
                hi[busy] = np.where(right, hi[busy], mid)
                busy = busy[lo[busy] < hi[busy]]
            bounds.append(lo)
        return bounds[1], bounds[2]

    def _index(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of the units end to end, and how many each unit has. A character without a
        piece is -1 less its place in the data."""
        data = np.frombuffer(b"\xff".join(units) + b"\xff", np.uint8)
        begins = np.flatnonzero(((data < 0x80) | (data >= 0xC0)) & (data != 255)).astype(np.int32)
        starts = np.concatenate(([0], np.cumsum([len(u) + 1 for u in units]))).astype(np.int32)
        ends = starts[1:] - 1
        starts = starts[:-1]
        suffixes, words = self._suffix_array(data, begins)
        lo, hi = self._ranges(suffixes, words)
        count = hi - lo
        piece = np.repeat(self.search_ids, count)
        skip = np.repeat((lo - np.concatenate(([0], np.cumsum(count)[:-1]))).astype(np.int32), count)
        source = suffixes[np.arange(count.sum(), dtype=np.int32) + skip]
        begins_here = np.zeros(len(data) + 1, bool)
        begins_here[begins] = True
        character = np.cumsum(begins_here, dtype=np.int32) - 1
        # Characters without a piece of their own are edges to themselves.
        next_begin = np.append(begins[1:], len(data) - 1)
        size = next_begin - begins - (data[next_begin - 1] == 255)
        single = np.zeros(len(data), bool)
        single[source[self.length[piece] == size[character[source]]]] = True
        lone = begins[~single[begins]]
        target = np.concatenate((source + self.length[piece], lone + size[character[lone]]))
        piece = np.concatenate((piece, -1 - lone))
        source = np.concatenate((source, lone))
        # Edges by position: those that start at the same character of their units go together.
        first_of_unit = character[starts]
        unit_size = np.diff(np.append(first_of_unit, len(begins)))
        depth = (np.arange(len(begins), dtype=np.int32) - np.repeat(first_of_unit, unit_size))[character[source]]
        order = np.argsort(depth, kind="stable")
        source, target, piece = source[order], target[order], piece[order]
        cut = np.searchsorted(depth[order], np.arange(depth.max(initial=-1) + 2))
        ending = np.full(len(data) + 1, _NONE, np.int32)
        at_start = np.zeros(len(data) + 1, bool)
        at_start[starts] = True
        # Few units go deep; beyond the last depth with many edges these are relaxed one by one.
        deep = int(np.flatnonzero(np.diff(cut) > FEW_EDGES).max(initial=0)) + 1
        for a, b in zip(cut[:deep], cut[1 : deep + 1], strict=False):
            s, t, p = source[a:b], target[a:b], piece[a:b]
            ok = at_start[s].copy()
            rest = np.flatnonzero(~ok)
            rest = rest[ending[s[rest]] != _NONE]
            ok[rest] = self.may_follow(ending[s[rest]], p[rest])
            ending[t[ok]] = p[ok]
        for a in range(cut[min(deep, len(cut) - 1)], len(source), EDGE_SLAB):
            b = a + EDGE_SLAB
            self._relax(source[a:b], target[a:b], piece[a:b], ending)
        return self._walk_back(data, starts, ends, ending)

    def _relax(self, source: np.ndarray, target: np.ndarray, piece: np.ndarray, ending: np.ndarray) -> None:
        """Relax edges in their order, one after another; none of them begins a unit."""
        n, pairs = len(self.rank), self.pairs
        if len(pairs) > _SEEN_SLOTS:
            pairs.clear()
        begins = np.unique(source)
        held = dict(zip(begins.tolist(), ending[begins].tolist(), strict=True))
        for s, t, p in zip(source.tolist(), target.tolist(), piece.tolist(), strict=True):
            before = held[s]
            if before == _NONE:
                continue
            if before >= 0 and p >= 0:
                key = before * n + p
                follows = pairs.get(key)
                if follows is None:
                    follows = pairs[key] = self._opens(before, p)
                if not follows:
                    continue
            held[t] = p
        ending[np.fromiter(held.keys(), np.int64, len(held))] = np.fromiter(held.values(), np.int32, len(held))

    def _walk_back(self, data, starts, ends, ending) -> tuple[np.ndarray, np.ndarray]:
        at, unit = ends.copy(), np.arange(len(starts))
        found, owner = [], []
        while len(unit) > FEW_EDGES:
            piece = ending[at]
            found.append(piece)
            owner.append(unit)
            lone = piece < 0
            step = np.where(lone, 0, self.length[np.where(lone, 0, piece)])
            step[lone] = at[lone] - (-1 - piece[lone])
            at = at - step
            busy = at > starts[unit]
            at, unit = at[busy], unit[busy]
        for end, one in zip(at.tolist(), unit.tolist(), strict=True):  # few are left: one by one
            low, first, taken = end + 1, int(starts[one]), []
            while end > first:
                if end < low:
                    low = max(first, end - EDGE_SLAB)
                    here = ending[low : end + 1].tolist()
                piece = here[end - low]
                taken.append(piece)
                end = end - int(self.length[piece]) if piece >= 0 else -1 - piece
            found.append(np.array(taken, np.int32))
            owner.append(np.full(len(taken), one))
        piece, unit = np.concatenate(found)[::-1], np.concatenate(owner)[::-1]
        order = np.argsort(unit, kind="stable")
        piece, unit = piece[order], unit[order]
        lone = np.flatnonzero(piece < 0)
        if len(lone):  # written as bytes
            begin = -1 - piece[lone]
            size = np.ones(len(piece), np.int64)
            lead = data[begin]
            size[lone] = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
            first = np.concatenate(([0], np.cumsum(size)))[lone]
            piece, unit = np.repeat(piece, size), np.repeat(unit, size)
            byte_ids = np.array(self.vocabulary.byte_ids)
            for k in range(4):
                more = size[lone] > k
                piece[first[more] + k] = byte_ids[data[begin[more] + k]]
        return piece.astype(np.int32), np.bincount(unit, minlength=len(starts))

    # ------------------------------------------------------------ texts

    def _learn(self, units: list[str]) -> None:
        at = 0
        while at < len(units):
            block, size = [], 0
            while at < len(units) and (size < INDEX_BYTES or not block):
                block.append(units[at].encode("utf-8", "replace"))
                size += len(block[-1])
                at += 1
            pieces, counts = self._index(block)
            self.pool.append(pieces)
            self.sizes.append(counts)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of the texts end to end, and how many each has."""
        if len(self.known) > KNOWN_UNITS:
            self.forget()
        known, new, numbers, n_units = self.known, [], [], []
        for text in texts:
            units = UNITS.findall(MARK + text.replace(" ", MARK)) if text else []
            n_units.append(len(units))
            for unit in set(units).difference(known):
                known[unit] = len(known)
                new.append(unit)
            numbers.extend(map(known.__getitem__, units))
        self._learn(new)
        pool = np.concatenate(self.pool) if self.pool else np.zeros(0, np.int32)
        sizes = np.concatenate(self.sizes) if self.sizes else np.zeros(0, np.int64)
        self.pool, self.sizes = [pool], [sizes]
        first = np.concatenate(([0], np.cumsum(sizes)))
        used = np.array(numbers, np.int64)
        count = sizes[used]
        out_first = np.concatenate(([0], np.cumsum(count)))
        take = np.repeat(first[used] - out_first[:-1], count) + np.arange(out_first[-1])
        unit_bounds = np.concatenate(([0], np.cumsum(n_units)))
        return pool[take], np.diff(out_first[unit_bounds])


@cache
def _matcher(vocabulary: Vocabulary) -> Matcher:
    return Matcher(vocabulary)


def _encode(vocabulary: Vocabulary):
    def run(texts: pa.Array) -> pa.Array:
        matcher, parts, at = _matcher(vocabulary), [], 0
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (size < BATCH_BYTES or end == at):
                size += int(sizes[end])
                end += 1
            taken = texts.slice(at, end - at).to_pylist()
            ids, counts = matcher.encode(taken)
            bounds = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            missing = np.array([t is None for t in taken] + [False])
            parts.append(pa.ListArray.from_arrays(pa.array(bounds, mask=missing), pa.array(ids)))
            at = end
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return run


@cache
def _raw(pieces: tuple[str | None, ...], byte_ids: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all pieces end to end, blanks for marks, and where each begins."""
    raw = [p.replace(MARK, " ").encode() if p else b"" for p in pieces]
    for value, i in enumerate(byte_ids):
        raw[i] = bytes([value])
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw])))


def _joined(raw: tuple[np.ndarray, np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of these pieces end to end, and the place up to which each goes."""
    data, begins = raw
    size = begins[ids + 1] - begins[ids]
    ends = np.cumsum(size)
    return data[np.repeat(begins[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)], ends


def _text(data: bytes) -> str:
    text = data.decode("utf-8", "replace").replace(MARK, " ")
    return text[1:] if text.startswith(" ") else text


def decoded(vocabulary: Vocabulary, ids: Iterable[int]) -> str:
    data, _ = _joined(_raw(vocabulary.pieces, vocabulary.byte_ids), np.fromiter(ids, np.int64))
    return _text(data.tobytes())


def _decode(vocabulary: Vocabulary):
    def run(ids: pa.Array) -> pa.Array:
        raw = _raw(vocabulary.pieces, vocabulary.byte_ids)
        values, bounds = ids.values.to_numpy(), ids.offsets.to_numpy()
        texts, at = [], 0
        while at < len(ids):
            end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + BATCH_IDS, "right")) - 1)
            end = min(end, len(ids))
            data, ends = _joined(raw, values[bounds[at] : bounds[end]])
            cuts = np.concatenate(([0], ends))[bounds[at : end + 1] - bounds[at]].tolist()
            data = data.tobytes()
            texts += [_text(data[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
            at = end
        return pa.array(texts, pa.string(), mask=~ids.is_valid().to_numpy(zero_copy_only=False))

    return run


def encode(text: Column, path: str = MODEL_PATH) -> Column:
    """The ids of a text's pieces. The vocabulary is read here and sent with the tasks."""
    return F.arrow_udf(_encode(Vocabulary.load(path)), "array<int>").asNondeterministic()(text)


def decode(ids: Column, path: str = MODEL_PATH) -> Column:
    return F.arrow_udf(_decode(Vocabulary.load(path)), "string").asNondeterministic()(ids)


def _round_trip(vocabulary: Vocabulary):
    there, back = _encode(vocabulary), _decode(vocabulary)

    def run(texts: pa.Array) -> pa.Array:
        ids, same = [], []
        for at in range(0, len(texts), BATCH_ROWS):
            some = texts.slice(at, BATCH_ROWS).cast(pa.string())
            ids.append(there(some))
            both_null = pc.and_(some.is_null(), ids[-1].is_null())
            same.append(pc.or_(both_null, pc.fill_null(pc.equal(back(ids[-1]), some), False)))
        ids = pa.concat_arrays(ids) if ids else pa.array([], pa.list_(pa.int32()))
        same = pa.concat_arrays(same) if same else pa.array([], pa.bool_())
        return pa.StructArray.from_arrays([ids, same], ["ids", "same"])

    return run


def round_trip(text: Column, path: str = MODEL_PATH) -> Column:
    """A struct of the ids and whether decoding them gives the text back, which is null for null, by one worker."""
    udf = F.arrow_udf(_round_trip(Vocabulary.load(path)), "ids array<int>, same boolean")
    return udf.asNondeterministic()(text)


def op6_pieces(spark, sf_dir: str) -> DataFrame:
    """The pieces of each text, and whether decoding them gives the text back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", round_trip(F.col("text")).alias("trip"))
    return docs.select(
        "doc_id",
        F.coalesce(F.size("trip.ids"), F.lit(0)).cast("long").alias("n_pieces"),
        "trip.ids",
        "trip.same",
    )
