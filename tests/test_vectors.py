"""Nearest chunks against brute force, with ties, copies and awkward vectors."""

import numpy as np
import pytest

from meterline.operators import vectors
from meterline.operators.vectors import vector_top_k


def brute_force(chunks, questions, k):
    def unit(v):
        norm = np.linalg.norm(v)
        return v / norm if norm else v

    found = set()
    for question, q in questions:
        scored = [(-round(float(unit(np.float32(v).astype(float)) @ unit(np.float32(q).astype(float))), 6) + 0.0, c) for c, v in chunks]
        for rank, (score, chunk) in enumerate(sorted(scored)[:k], 1):
            found.add((question, chunk, -score + 0.0, rank))
    return found


def frames(spark, chunks, questions, kind="long", parts=5):
    schema = f"{{}}_id {kind}, embedding array<float>"
    return (
        spark.createDataFrame(chunks, schema.format("chunk")).repartition(parts),
        spark.createDataFrame(questions, schema.format("question")),
    )


def collected(df):
    return {tuple(r) for r in df.select("question_id", "chunk_id", "score", "hit_rank").collect()}


@pytest.fixture
def some():
    random = np.random.default_rng(7)
    vectors_ = random.integers(-2, 3, size=(300, 4)).astype(float)
    # A third of all chunks are copies of one vector.
    vectors_[100:200] = vectors_[0]
    vectors_[5] = 0.0
    chunks = [(i, v.tolist()) for i, v in enumerate(vectors_)]
    questions = [(i, v.tolist()) for i, v in enumerate(random.normal(size=(23, 4)))]
    questions += [(50, vectors_[0].tolist()), (51, [0.0] * 4)]
    return chunks, questions


@pytest.mark.parametrize("layout", ["broadcast", "grid"])
@pytest.mark.parametrize("k", [1, 5, 400])
def test_matches_brute_force(spark, some, layout, k, monkeypatch):
    monkeypatch.setattr(vectors, "GRID_QUESTION_ENTRIES", 40)
    monkeypatch.setattr(vectors, "GRID_CHUNK_ENTRIES", 280)
    monkeypatch.setattr(vectors, "BLOCK_SCORES", 500)
    monkeypatch.setattr(vectors, "PENDING", 50)
    chunks, questions = some
    found = vector_top_k(*frames(spark, chunks, questions), k, layout=layout)
    assert collected(found) == brute_force(chunks, questions, k)


@pytest.mark.parametrize("layout", ["broadcast", "grid"])
def test_text_ids_and_unusable_vectors(spark, layout):
    chunks = [("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("c", None), ("d", []), (None, [1.0, 0.0])]
    questions = [("q", [3.0, 0.0]), ("none", None)]
    found = vector_top_k(*frames(spark, chunks, questions, "string"), 5, layout=layout)
    assert collected(found) == {("q", "a", 1.0, 1), ("q", "b", 1.0, 2)}


@pytest.mark.parametrize("layout", ["broadcast", "grid"])
def test_empty_sides(spark, layout):
    one, none = [(1, [1.0])], []
    for chunks, questions in ((one, none), (none, one), (none, none)):
        found = vector_top_k(*frames(spark, chunks, questions), 3, layout=layout)
        assert collected(found) == set()


BAD = {
    "inf": [float("inf"), 1.0],
    "nan": [float("nan"), 1.0],
    "null": [None, 1.0],
}


@pytest.mark.parametrize("layout", ["broadcast", "grid"])
@pytest.mark.parametrize("kind", BAD)
def test_bad_vectors_are_named_or_left_out(spark, layout, kind):
    chunks = [(1, [1.0, 0.0]), (77, BAD[kind]), (3, [-1.0, 0.0])]
    sides = frames(spark, chunks, [(9, [1.0, 0.0])])
    with pytest.raises(Exception, match="the vector of 77 has a NULL or non-finite entry"):
        vector_top_k(*sides, 3, layout=layout).collect()
    found = vector_top_k(*sides, 3, layout=layout, on_bad_vector="drop")
    assert collected(found) == {(9, 1, 1.0, 1), (9, 3, -1.0, 2)}


@pytest.mark.parametrize("layout", ["broadcast", "grid"])
def test_vectors_of_other_lengths_are_an_error(spark, layout):
    chunks = [(1, [1.0, 0.0, 0.0]), (2, [1.0])]
    with pytest.raises(Exception, match=r"the vector of \d has \d entries, not"):
        vector_top_k(*frames(spark, chunks, [(9, [1.0, 0.0])], parts=1), 3, layout=layout).collect()


@pytest.mark.parametrize("layout", ["broadcast", "grid"])
def test_large_doubles_do_not_overflow(spark, layout):
    chunks = spark.createDataFrame([(1, [1e200, 0.0]), (2, [1e-200, 1e-200])], "chunk_id long, embedding array<double>")
    questions = spark.createDataFrame([(9, [1e300, 0.0])], "question_id long, embedding array<double>")
    found = vector_top_k(chunks, questions, 2, layout=layout)
    assert collected(found) == {(9, 1, 1.0, 1), (9, 2, 0.707107, 2)}


def test_too_many_questions_for_a_broadcast_are_refused(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BROADCAST_ENTRIES", 3)
    with pytest.raises(ValueError, match="grid"):
        vector_top_k(*frames(spark, [(1, [1.0, 0.0])], [(1, [1.0, 0.0]), (2, [1.0, 0.0])]), 1, layout="broadcast")
