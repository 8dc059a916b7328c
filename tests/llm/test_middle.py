"""Fill-in-middle against slicing of text, and the piece table against joined bytes."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meterline.llm import middle
from tests.compare import connect, differences
from tests.conftest import SF_DIR
from tests.llm.conftest import ROWS


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def formed(doc_id, text):
    text = text or ""
    digits, n = sha(f"1:{'' if doc_id is None else doc_id}"), len(text)
    h = [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, mid, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{mid}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{mid}"


def check(spark, rows):
    done = middle.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"))
    back = done.select("*", middle.rebuilt(F.col("middle.output"), F.col("middle.form")).alias("back")).collect()
    assert len(back) == len(rows)
    for r in back:
        want = formed(r.row.doc_id, r.row.text)
        have = r.middle
        assert (have.n, have.form, have.prefix_chars, have.middle_chars, have.output) == want
        assert have.output_sha256 == sha(have.output)
        assert r.back.text == (r.row.text or "") and r.back.sha256 == sha(r.row.text or "")


def test_fixture_and_clashing_columns(spark, docs, no_docs):
    check(spark, [row[:2] for row in ROWS])
    clash = docs.withColumns({name: F.lit(1) for name in ("middle", "form", "output", "n")})
    kept = middle.fill_in_middle(clash)
    assert kept.columns == ["row", "middle"] and kept.select("row.*").columns == clash.columns
    assert kept.count() == docs.count()
    assert middle.fill_in_middle(no_docs).count() == 0


def test_awkward_texts(spark):
    texts = ["<", "<P", "P><", "a<S>b", "<M", ">", "é☃𝄞" * 7, "<<PP>>", "\u0000x\n", "S>", "x" * 100_000, "𝄞" * 50_000]
    check(spark, [(i + 50 * k, t) for k in range(8) for i, t in enumerate(texts)])


def test_all_forms_occur():
    found = {formed(i, "some words of text")[1] for i in range(100)}
    assert found == {"plain", "psm", "spm"}


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.lists(st.integers(0, 40), max_size=5))
def test_cutting_keeps_the_bytes(data, positions):
    cuts = sorted(min(p, len(data)) for p in positions)
    pieces = middle.Pieces.of(data).cut(cuts)
    assert pieces.joined() == data and pieces.digest() == hashlib.sha256(data).hexdigest()
    assert len(pieces.descriptors) == len(cuts) + 1
    bounds = [0, *cuts, len(data)]
    assert [bytes(p) for p in pieces.stream()] == [data[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
    order = list(range(len(cuts) + 1))[::-1]
    turned = pieces.arranged(order)
    assert turned.arranged(middle.inverse(order)).joined() == data


@pytest.mark.parametrize("form", middle.ARRANGEMENTS)
@given(parts=st.tuples(*[st.text("<PSM>a", max_size=6)] * 3))
@settings(max_examples=200, deadline=None)
def test_sentinels_are_found_again(form, parts):
    text = "".join(parts)
    if any(s in text for s in ("<P>", "<S>", "<M>")) and form != "plain":
        return
    raw = [p.encode() for p in parts]
    pieces = middle.Pieces.of(b"".join(raw)).cut([len(raw[0]), len(raw[0]) + len(raw[1])])
    if form == "plain":
        pieces = middle.Pieces.of(b"".join(raw))
    output = pieces.arranged(middle.ARRANGEMENTS[form]).joined()
    assert middle.restored(output, form).joined() == text.encode()


def test_matches_sql(spark):
    assert differences(middle.op12_middle(spark, SF_DIR), connect(SF_DIR), middle.OP12_SQL) == []
