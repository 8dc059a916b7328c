"""The stored index against brute force, with clusters that bounds exclude and such that none does."""

import numpy as np
import pytest

from meterline.operators import vector_index, vectors
from meterline.operators.vector_index import build_index, extend_index, open_index, search_index
from tests.test_vectors import BAD, brute_force, collected, frames


@pytest.fixture
def grouped():
    """Chunks around eight far directions, a third of them copies, and a question near each."""
    random = np.random.default_rng(5)
    centres = np.eye(8)
    around = np.repeat(centres, 60, axis=0) + random.normal(scale=0.02, size=(480, 8))
    around[100:260] = around[100]
    chunks = [(i, v.tolist()) for i, v in enumerate(around)] + [(1000, [0.0] * 8)]
    questions = [(i, v.tolist()) for i, v in enumerate(centres + random.normal(scale=0.01, size=(8, 8)))]
    return chunks, questions


@pytest.fixture
def spread():
    """Vectors of no shape at all: no cluster can be left out before its members are scored."""
    random = np.random.default_rng(6)
    chunks = [(i, v.tolist()) for i, v in enumerate(random.integers(-2, 3, size=(300, 4)).astype(float))]
    questions = [(i, v.tolist()) for i, v in enumerate(random.normal(size=(20, 4)))]
    return chunks, [*questions, (50, chunks[0][1]), (51, [0.0] * 4)]


@pytest.mark.parametrize(("which", "n_clusters"), [("grouped", None), ("grouped", 8), ("spread", None)])
def test_matches_brute_force(spark, tmp_path, request, monkeypatch, which, n_clusters):
    monkeypatch.setattr(vector_index, "GRID_QUESTION_ENTRIES", 24)
    monkeypatch.setattr(vector_index, "GRID_CHUNK_ENTRIES", 280)
    monkeypatch.setattr(vectors, "BLOCK_SCORES", 500)
    chunks, questions = request.getfixturevalue(which)
    given, asked = frames(spark, chunks, questions)
    index = build_index(given, str(tmp_path / "index"), n_clusters)
    for k in (1, 5, 600) if which == "spread" else (5,):
        found = search_index(index, asked, k)
        assert collected(found.hits) == brute_force(chunks, questions, k)
        report = found.report.collect()
        scored = sum(r.n_scored for r in report)
        assert {r.n_all for r in report} == {len(chunks) * len(questions)} and scored <= len(chunks) * len(questions)
        if which == "grouped" and n_clusters is None and k == 5:
            assert scored < 0.3 * len(chunks) * len(questions)


def test_a_cluster_that_no_bound_excludes(spark, tmp_path, grouped):
    """A question between all groups: every cluster is visited, each pair is scored once."""
    chunks, _ = grouped
    question = [(7, [1.0] * 8)]
    given, asked = frames(spark, chunks, question)
    found = search_index(build_index(given, str(tmp_path / "index"), 8), asked, 600)
    assert collected(found.hits) == brute_force(chunks, question, 600)
    assert sum(r.n_scored for r in found.report.collect()) == len(chunks)


def test_other_partitions_are_not_read(spark, tmp_path, grouped):
    given, asked = frames(spark, *grouped)
    index = build_index(given, str(tmp_path / "index"), 8)
    some = index.members.filter("cluster IN (0, 1)")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cluster" in plan


def test_extended_index(spark, tmp_path, grouped, spread):
    """Chunks far from every centre widen the clusters; the hits stay exact."""
    chunks, questions = grouped
    random = np.random.default_rng(8)
    late = [(5000 + i, v.tolist()) for i, v in enumerate(random.normal(size=(200, 8)))]
    path = str(tmp_path / "index")
    given, asked = frames(spark, chunks, questions)
    index = build_index(given, path, 8)
    index = extend_index(index, path, frames(spark, late, questions)[0])
    assert collected(search_index(index, asked, 9).hits) == brute_force(chunks + late, questions, 9)
    again = open_index(spark, path)
    assert again.members.count() == len(chunks) + len(late) == again.clusters.agg({"n": "sum"}).first()[0]


@pytest.mark.parametrize("sides", [(1, 0), (0, 1), (0, 0)])
def test_empty_sides(spark, tmp_path, sides):
    chunks, questions = ([(1, [1.0, 2.0])] * n for n in sides)
    given, asked = frames(spark, chunks, questions, parts=1)
    assert search_index(build_index(given, str(tmp_path / "i")), asked, 3).hits.count() == 0


def test_only_zero_vectors(spark, tmp_path):
    chunks, questions = [(i, [0.0, 0.0]) for i in range(5)], [(1, [1.0, 0.0]), (2, [0.0, 0.0])]
    given, asked = frames(spark, chunks, questions)
    found = search_index(build_index(given, str(tmp_path / "i")), asked, 3).hits
    assert collected(found) == brute_force(chunks, questions, 3)


@pytest.mark.parametrize("kind", BAD)
def test_bad_vectors(spark, tmp_path, kind):
    chunks = [(1, [1.0, 0.0]), (77, BAD[kind]), (3, [-1.0, 0.0])]
    given, asked = frames(spark, chunks, [(9, [1.0, 0.0])])
    with pytest.raises(Exception, match="the vector of 77 has a NULL or non-finite entry"):
        build_index(given, str(tmp_path / "a"))
    index = build_index(given, str(tmp_path / "b"), on_bad_vector="drop")
    assert collected(search_index(index, asked, 3).hits) == {(9, 1, 1.0, 1), (9, 3, -1.0, 2)}


def test_questions_are_sent_once_to_a_column_of_clusters(spark, tmp_path, monkeypatch, spread):
    """Vectors of no shape: every question visits all 64 clusters, and is not sent once for each."""
    sent = spark.sparkContext.accumulator(0)

    class Counted(vectors._Scan):
        def __init__(self, targets, *more):
            sent.add(len(targets))
            super().__init__(targets, *more)

    monkeypatch.setattr(vector_index, "_Scan", Counted)
    chunks, questions = spread
    given, asked = frames(spark, chunks, questions)
    found = search_index(build_index(given, str(tmp_path / "index"), 64), asked, 600)
    assert collected(found.hits) == brute_force(chunks, questions, 600)
    report = found.report.collect()
    assert sum(r.n_scored for r in report) == len(chunks) * len(questions)
    assert sent.value < 20 * len(questions)
