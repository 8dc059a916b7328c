"""Ranking, quota, context and citations of hits, and prompts, on literal rows."""

import json

import pytest

from meterline.functions.models import embed_texts, generate
from meterline.operators import hits as steps
from meterline.plans import answers

SCHEMA = (
    "question_id long, hit_rank int, row_id string, tenant_name string, region string, "
    "chunk_text string, score double"
)


@pytest.fixture
def hits(spark):
    """Hits given as (tenant, score[, text]) in order of arrival, for question 1."""

    def make(*given, question=1):
        filled = [
            (question, i, f"id{i}", one[0], "kr", one[2] if len(one) > 2 else f"text{i}", one[1])
            for i, one in enumerate(given, 1)
        ]
        return steps.as_hits(spark.createDataFrame(filled, SCHEMA))

    return make


def context(df):
    entries = steps.context_entries(df).orderBy("question_id", "number")
    return [(r.number, r.chunk) for r in entries.collect()]


def test_missing_scores_last_and_ties_in_arrival_order(hits):
    df = steps.rank_hits_in_tenant(hits(("A", None), ("A", 0.5), ("A", 0.9), ("A", 0.5), ("A", -1.0)))
    assert [r.row_id for r in df.orderBy("tenant_rank").collect()] == ["id3", "id2", "id4", "id5", "id1"]


def test_best_score_is_null_without_scores(hits):
    df = steps.best_score(hits(("A", None), ("B", 0.2), ("B", 0.4)))
    assert {(r.tenant_name, r.best_score) for r in df.collect()} == {("A", None), ("B", 0.4)}


@pytest.mark.parametrize("tenants, share", [(1, 6), (2, 3), (3, 2), (4, 1), (6, 1), (7, 1), (9, 1)])
def test_quota(hits, tenants, share):
    given = [(f"T{i % tenants}", 1.0 - i / 100) for i in range(tenants * 7)]
    kept = [chunk.split("]")[0] for _, chunk in context(hits(*given))]
    assert len(kept) == tenants * share
    assert all(kept.count(name) == share for name in set(kept))


def test_numbers_start_at_two_in_order_of_first_appearance(hits):
    df = hits(("B", 0.1), ("A", 0.9), ("B", 0.8), ("A", None), (None, 0.5))
    assert context(df) == [
        (2, "[B] text3"),
        (3, "[B] text1"),
        (4, "[A] text2"),
        (5, "[A] text4"),
        (6, "[(unknown-tenant)] text5"),
    ]
    assert steps.join_context(steps.context_entries(df)).first().context.startswith("[2] [B] text3\n\n[3] ")


def test_null_and_empty_tenants_share_a_group(hits):
    df = hits((None, 0.1), ("", 0.3))
    (citation,) = steps.group_citations(df).collect()
    assert (citation.tenant_name, citation.best_score) == ("(unknown-tenant)", 0.3)
    flat = steps.flatten_citations(steps.group_citations(df)).orderBy("tenant_rank").collect()
    assert [(r.row_id, r.tenant_name, r.best_score) for r in flat] == [("id2", "", 0.3), ("id1", None, 0.3)]


def test_citations_are_not_cut_by_the_quota(hits):
    df = hits(*[(f"T{i % 7}", 0.5) for i in range(21)])
    assert [len(r.chunks) for r in steps.group_citations(df).collect()] == [3] * 7
    assert len(context(df)) == 7


def test_questions_do_not_mix(hits):
    df = hits(("A", 0.5), ("B", 0.4)).union(hits(("A", 0.9), question=2))
    entries = steps.context_entries(df).collect()
    assert sorted((r.question_id, r.number, r.quota) for r in entries) == [(1, 2, 3), (1, 3, 3), (2, 2, 6)]


def test_prompts_include_questions_without_hits(spark, hits):
    questions = spark.createDataFrame([(1, "why?"), (5, "who?")], "question_id long, question string")
    prompts = {r.question_id: r for r in answers.answer_prompts(hits(("A", 0.5)), questions, "S").collect()}
    assert "\n[2] [A] text1\n\n# User question\nwhy?\n" in prompts[1].prompt
    assert prompts[5].n_chunks == 0 and "rows)\n\n\n# User question\nwho?\n" in prompts[5].prompt


def _vectors(texts):
    return [[float(text.count("a")), float(text.count("b")), 1.0] for text in texts]


def _echo():
    def chat(talks, temperature):
        contents = [f"{talk[0]['content']}|{talk[1]['role']}|{temperature}" for talk in talks]
        return [json.dumps({"choices": [{"message": {"content": c}}]}) for c in contents]

    return chat


def test_answer_from_question_to_citation(spark):
    chunks = spark.createDataFrame(
        [(1, "T", "kr", "aaa"), (2, "U", "kr", "bbb"), (3, None, "kr", "ab")],
        "id long, tenant string, place string, body string",
    )
    vectors = lambda texts: _vectors(texts)
    chunks = embed_texts(chunks, "body", vectors)
    questions = spark.createDataFrame([(9, "aaaa"), (8, "bb")], "question_id long, question string")
    answered, citations = answers.answer(chunks, questions, _echo(), k=2, embed=vectors, columns=("id", "tenant", "place", "body"))
    assert {r.answer.split("|", 1)[1] for r in answered.collect()} == {"user|0.2"}
    first = citations.filter("question_id = 9 AND tenant_first = 1").first()
    assert (first.tenant_name, [c.chunk_text for c in first.chunks]) == ("T", ["aaa"])


def test_embed_texts_checks_and_hashing(spark):
    from pyspark.ml.feature import HashingTF

    df = spark.createDataFrame([(1, "Kosten kosten höher"), (2, None), (3, " .,")], "id long, text string")
    with pytest.raises(TypeError):
        embed_texts(df, "id")
    vectors = {r.id: r.embedding for r in embed_texts(df, "text", dimensions=32).collect()}
    words = HashingTF(numFeatures=32)
    expected = [0.0] * 32
    for word in ("kosten", "kosten", "höher"):
        expected[words.indexOf(word)] += 1.0
    length = sum(x * x for x in expected) ** 0.5
    assert vectors[1] == pytest.approx([x / length for x in expected], abs=1e-6)
    assert vectors[2] == vectors[3] == [0.0] * 32
    assert embed_texts(df.limit(0), "text", lambda texts: []).count() == 0


def test_functions_must_answer_every_row(spark):
    df = spark.createDataFrame([("x",), ("y",)], "prompt string").coalesce(1)
    with pytest.raises(Exception, match="2 texts gave 1 vectors"):
        embed_texts(df, "prompt", lambda texts: [[1.0]]).collect()
    with pytest.raises(Exception, match="2 prompts gave 0 responses"):
        generate(df, lambda talks, temperature: []).collect()


def test_undecodable_answers_come_back_whole(spark):
    df = spark.createDataFrame([("x",)], "prompt string")
    assert generate(df, lambda talks, temperature: ["oops"]).first().answer == "oops"


@pytest.mark.parametrize("layout", ["grid", "broadcast"])
def test_each_question_is_embedded_once(spark, tmp_path, layout):
    """Both outputs are collected; every call of the embedding function leaves a line."""
    log = tmp_path / "calls"
    log.mkdir()

    def embed(texts):
        import uuid

        (log / uuid.uuid4().hex).write_text("\n".join(texts))
        return [[float(len(t)), 1.0] for t in texts]

    def chat(talks, temperature):
        return ['{"choices": [{"message": {"content": "yes"}}]}' for _ in talks]

    chunks = spark.createDataFrame(
        [(i, "t", "r", f"text {i}", [float(i), 1.0]) for i in range(20)],
        "chunk_id long, tenant_name string, region string, text string, embedding array<double>",
    )
    asked = [(i, f"question {i}") for i in range(10)]
    questions = spark.createDataFrame(asked, "question_id long, question string")
    replies, citations = answers.answer(chunks, questions, chat, 3, embed, layout=layout)
    assert replies.count() == 10 and citations.count() == 10
    seen = [line for call in log.iterdir() for line in call.read_text().splitlines()]
    assert sorted(seen) == sorted(q for _, q in asked)


def test_hits_without_a_text_row_are_kept(spark):
    chunks = spark.createDataFrame([(1, "t", "r", "one")], "chunk_id long, tenant_name string, region string, text string")
    vectors = spark.createDataFrame([(1, [1.0]), (2, [1.0])], "chunk_id long, embedding array<double>")
    questions = spark.createDataFrame([(7, [1.0])], "question_id long, embedding array<double>")
    hits = answers.retrieve(chunks, questions, 2, vectors=vectors)
    found = sorted((h.row_id, h.chunk_text, h.tenant_key) for h in hits.collect())
    assert found == [(1, "one", "t"), (2, "", "(unknown-tenant)")]


def _murmur3(data: bytes, seed: int = 42) -> int:
    """Hash of words as the feature hashing uses it, signed 32 bits, whole words of four bytes first."""
    mask = 0xFFFFFFFF
    rotate = lambda x, n: ((x << n) | (x >> (32 - n))) & mask
    value = seed
    whole = len(data) // 4 * 4
    blocks = [int.from_bytes(data[i : i + 4], "little") for i in range(0, whole, 4)]
    for block in blocks:
        value ^= rotate(block * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
        value = (rotate(value, 13) * 5 + 0xE6546B64) & mask
    if len(data) > whole:
        tail = int.from_bytes(data[whole:], "little")
        value ^= rotate(tail * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
    value ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        value = (value ^ (value >> shift)) * factor & mask
    value ^= value >> 16
    return value - (1 << 32) if value >> 31 else value


def test_hashed_vector_by_content(spark):
    from meterline.functions.models import embed_texts

    df = spark.createDataFrame([("Costs rose; costs of spark fell.",), ("",)], "text string")
    have = [r.embedding for r in embed_texts(df, "text").collect()]
    want = [0.0] * 256
    for word in "costs rose costs of spark fell".split():
        want[_murmur3(word.encode()) % 256] += 1.0
    norm = sum(x * x for x in want) ** 0.5
    assert have[0] == pytest.approx([x / norm for x in want], abs=1e-6)
    assert have[1] == [0.0] * 256


def test_words_are_counted_once_per_text(spark, tmp_path):
    """Not once for each entry of its vector, as where the count stands beside the generator."""
    from meterline.registry.queries import QUERIES

    texts = [(1, "Costs rose; costs of spark fell."), (2, ""), (3, None), (None, "costs costs")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["embedded_words"](spark, str(tmp_path))
    want = {}
    for doc_id, text in texts:
        for word in (text or "").lower().replace(";", "").replace(".", "").split():
            key = doc_id, _murmur3(word.encode()) % 256
            want[key] = want.get(key, 0) + 1
    assert {(r.doc_id, r.entry): r.n_words for r in found.collect()} == want
    steps = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    generate = next(i for i, step in enumerate(steps) if "Generate" in step)
    counting = [i for i, step in enumerate(steps) if "regexp_count" in step.lower() or "regexpcount" in step.lower() or "aggregate(" in step]
    assert counting and min(counting) > generate  # below it in the plan
