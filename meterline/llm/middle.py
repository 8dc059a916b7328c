"""Fill-in-middle transformation with a piece table.

A document becomes a descriptor over an immutable buffer of its UTF-8 bytes; a second buffer
holds the sentinels. Cutting splits descriptors, an arrangement permutes them, and sentinel
descriptors are put between them. Bytes are never moved: a digest streams the descriptors, and
text is only joined where it is asked for. An output is taken apart the same way, as
descriptors over its own bytes, and the inverse permutation gives the text back.

Cuts, form and order depend on the document's id alone, so reruns agree and no row needs
another; nothing is shuffled.

Defined results: a null text is empty; an empty text, and one that contains a sentinel, stay
plain; a null id is hashed as no digits, ids of other types as their text; repeated rows give
repeated results; texts are cut whole, in code points; columns whose names the result uses are
kept in ``row`` by ``fill_in_middle``; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.llm.common import BEGINS, table

# The sentinels, and the shares of plain texts and of suffix-first ones, in percent.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN_FROM = 90
SPM_BELOW = 20
SENTINELS = PREFIX + SUFFIX + MIDDLE
#: For each form the order of its parts: sentinels by their text, parts by their place in the document.
ARRANGEMENTS: dict[str, tuple[bytes | int, ...]] = {
    "plain": (0,),
    "psm": (PREFIX, 0, SUFFIX, 2, MIDDLE, 1),
    "spm": (SUFFIX, 2, PREFIX, 0, MIDDLE, 1),
}
_TEXT, _SENTINELS = 0, 1


@dataclass(frozen=True)
class Pieces:
    """Descriptors (buffer, start, end) over immutable buffers; the document is their bytes in order."""

    buffers: tuple[memoryview, ...]
    descriptors: tuple[tuple[int, int, int], ...]

    @staticmethod
    def of(text: bytes | memoryview) -> Pieces:
        view = memoryview(text)
        return Pieces((view, memoryview(SENTINELS)), ((_TEXT, 0, len(view)),))

    def cut(self, positions: Sequence[int]) -> Pieces:
        """The descriptors split at these byte positions of the document, empty ones included."""
        parts, at, wanted = [], 0, list(positions)
        for buffer, start, end in self.descriptors:
            while wanted and wanted[0] <= at + end - start:
                middle = start + wanted.pop(0) - at
                parts.append((buffer, start, middle))
                at, start = at + middle - start, middle
            parts.append((buffer, start, end))
            at += end - start
        return Pieces(self.buffers, tuple(parts))

    def arranged(self, order: Sequence[bytes | int]) -> Pieces:
        """The numbered descriptors in a new order, with descriptors of sentinels between them."""
        taken = []
        for one in order:
            if isinstance(one, int):
                taken.append(self.descriptors[one])
            else:
                start = SENTINELS.index(one)
                taken.append((_SENTINELS, start, start + len(one)))
        return Pieces(self.buffers, tuple(taken))

    def stream(self) -> Iterator[memoryview]:
        return (self.buffers[buffer][start:end] for buffer, start, end in self.descriptors)

    def digest(self) -> str:
        state = hashlib.sha256()
        for part in self.stream():
            state.update(part)
        return state.hexdigest()

    def joined(self) -> bytes:
        return b"".join(self.stream())


def inverse(order: Sequence[bytes | int]) -> list[int]:
    """For each part of the document its place among the descriptors of the output."""
    place = {one: at for at, one in enumerate(order)}
    return [place[part] for part in range(sum(isinstance(one, int) for one in order))]


def taken_apart(output: bytes | memoryview, form: str) -> Pieces:
    """An output as descriptors over its own bytes, sentinels and parts by turns.

    No sentinel is in the document and none can arise where parts meet, so the first one found is the one put there.
    """
    pieces, order = Pieces.of(output), ARRANGEMENTS[form]
    raw, cuts, at = bytes(output), [], 0
    for one in order:
        if not isinstance(one, int):
            at = raw.index(one, at)
            cuts += [at, at + len(one)]
            at += len(one)
    # The first sentinel opens the output: the cut before it is no cut.
    return pieces.cut(cuts[1:])


def restored(output: bytes | memoryview, form: str) -> Pieces:
    return taken_apart(output, form).arranged(inverse(ARRANGEMENTS[form]))


def choice(doc_id: str | None) -> list[int]:
    """The four numbers that decide on a document."""
    digits = hashlib.sha256(f"1:{doc_id or ''}".encode()).hexdigest()
    return [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]


def transformed(text: memoryview, doc_id: str | None) -> tuple[Pieces, str, int, int, int]:
    """The pieces of the output, the form, and the code points of text, prefix and middle."""
    one, two, three, four = choice(doc_id)
    begins = np.flatnonzero(BEGINS[np.frombuffer(text, np.uint8)])
    n, raw = len(begins), bytes(text)
    pieces = Pieces.of(text)
    if not n or PREFIX in raw or SUFFIX in raw or MIDDLE in raw or three % 100 >= PLAIN_FROM:
        return pieces, "plain", n, 0, 0
    first, last = sorted((one % (n + 1), two % (n + 1)))
    byte_at = [int(begins[k]) if k < n else len(raw) for k in (first, last)]
    form = "spm" if four % 100 < SPM_BELOW else "psm"
    return pieces.cut(byte_at).arranged(ARRANGEMENTS[form]), form, n, first, last - first


def _views(texts: pa.Array) -> Iterator[memoryview]:
    """The bytes of each text, in place; null is empty."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8).tolist()
    data = memoryview(texts.buffers()[2] or b"")
    return (data[a:b] for a, b in zip(bounds, bounds[1:], strict=False))


_FORMED = {
    "form": pa.string(),
    "n": pa.int64(),
    "prefix_chars": pa.int64(),
    "middle_chars": pa.int64(),
    "output": pa.string(),
    "output_sha256": pa.string(),
}
_FORMED_SQL = "form string, n bigint, prefix_chars bigint, middle_chars bigint, output string, output_sha256 string"
_RESTORED = {"text": pa.string(), "sha256": pa.string()}


def _struct(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.Array:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)]
    return pa.StructArray.from_arrays(arrays, list(kinds))


def _form(texts: pa.Array, ids: pa.Array) -> pa.Array:
    rows = []
    for text, doc_id in zip(_views(texts), ids.to_pylist(), strict=True):
        pieces, form, n, prefix, middle = transformed(text, doc_id)
        cut = (None, None) if form == "plain" else (prefix, middle)
        rows.append((form, n, *cut, pieces.joined().decode(), pieces.digest()))
    return _struct(rows, _FORMED)


def _restore(outputs: pa.Array, forms: pa.Array) -> pa.Array:
    rows = []
    for output, form in zip(_views(outputs), forms.to_pylist(), strict=True):
        pieces = restored(output, form or "plain")
        rows.append((pieces.joined().decode(), pieces.digest()))
    return _struct(rows, _RESTORED)


def formed(text: Column, doc_id: Column) -> Column:
    """A struct of the form, the sizes in code points, the output and its digest."""
    udf = F.arrow_udf(_form, _FORMED_SQL).asNondeterministic()  # evaluated once, however many fields are used
    return udf(text, doc_id.cast("string"))


def rebuilt(output: Column, form: Column) -> Column:
    """A struct of the text that an output was made of, from the output and its form alone, and its digest."""
    return F.arrow_udf(_restore, "text string, sha256 string").asNondeterministic()(output, form)


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row as a struct ``row``, with the struct ``middle`` of its output; ``rebuilt`` undoes it."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row, formed(F.col(f"`{text}`"), F.col(f"`{doc_id}`")).alias("middle"))


def op12_middle(spark, sf_dir: str) -> DataFrame:
    done = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = done.select("row.doc_id", "middle", rebuilt(F.col("middle.output"), F.col("middle.form")).alias("back"))
    return back.select(
        "doc_id",
        *[f"middle.{name}" for name in ("n", "form", "prefix_chars", "middle_chars", "output_sha256")],
        F.col("back.sha256").alias("restored_sha256"),
    )


OP12_SQL = f"""
WITH hashed AS (
    SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
           sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS digits
    FROM documents
), numbers AS (
    SELECT doc_id, text, n, ('0x' || substr(digits, 1, 8))::BIGINT % (n + 1) AS one,
           ('0x' || substr(digits, 9, 8))::BIGINT % (n + 1) AS two,
           ('0x' || substr(digits, 17, 8))::BIGINT % 100 AS three, ('0x' || substr(digits, 25, 8))::BIGINT % 100 AS four
    FROM hashed
), cut AS (
    SELECT doc_id, text, n, CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
               OR three >= {PLAIN_FROM} THEN 'plain' WHEN four < {SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form,
           least(one, two) AS first, greatest(one, two) AS last
    FROM numbers
), parts AS (
    SELECT *, substr(text, 1, first) AS prefix, substr(text, first + 1, last - first) AS middle, substr(text, last + 1) AS suffix
    FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN first END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN last - first END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
