"""Column functions on text and the decoding of service responses, on literal rows."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meterline.functions import responses, text


def apply(spark, function, *values, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r[0] for r in df.select(function(F.col("x"))).collect()]


def test_tenant_key_and_default_text(spark):
    assert apply(spark, text.tenant_key, None, "", " ", "T") == [
        "(unknown-tenant)",
        "(unknown-tenant)",
        " ",
        "T",
    ]
    assert apply(spark, text.default_text, None, "x") == ["", "x"]


def test_safe_score_follows_float(spark):
    given = ["0.5", " 1e3 ", "abc", "1.5d", "2f", "", None, "-inf", "nan", ".5", "5."]
    have = apply(spark, text.safe_score, *given)
    for one, score in zip(given, have):
        try:
            want = float(one)
        except (TypeError, ValueError):
            want = None
        assert repr(score) == repr(want), one


@pytest.mark.parametrize("length", [799, 800, 801])
def test_truncation_boundary(spark, length):
    (short,) = apply(spark, text.trim_truncate, "　\t" + "é" * length + " \n")
    assert short == ("é" * 800 + "…" if length > 800 else "é" * length)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0 　​😀", max_size=12), min_size=20, max_size=40))
def test_strip_follows_str_strip(spark, values):
    assert apply(spark, text.strip, *values) == [v.strip() for v in values]


def test_split_trim_list(spark):
    assert apply(spark, text.split_trim_list, " a, ,b ,,c", "", None) == [["a", "b", "c"], [], None]


def test_prompt_layout(spark):
    df = spark.createDataFrame([("[2] [T] x", "why?")], "c string, q string")
    prompt = df.select(text.build_prompt(F.col("c"), F.col("q"), "SYSTEM")).first()[0]
    assert prompt == (
        "SYSTEM\n\n# Context (tenant monthly usage rows)\n[2] [T] x\n\n# User question\nwhy?\n\n"
        "# Answer in business terms, focusing on tenant-level usage & cost insights.\n"
    )


@pytest.fixture
def bodies(spark):
    def make(*given):
        texts = [one if isinstance(one, str) else json.dumps(one, ensure_ascii=False) for one in given]
        return spark.createDataFrame(list(enumerate(texts)), "id long, body string").repartition(1)

    return make


def test_hit_rows(bodies):
    df = bodies(
        {"result": {"data_array": [[7, "T", "kr", "text", 0.5], [1, 2, 3, 4], ["b", None, None, None, "x", 9]]}},
        {"result": {"data_array": []}},
        {"result": []},
        {},
        "no json",
    )
    hits = [tuple(r) for r in responses.decode_hit_rows(df).collect()]
    assert hits == [
        (0, 1, "7", "T", "kr", "text", 0.5, "T"),
        (0, 2, "b", None, None, "", None, "(unknown-tenant)"),
    ]


def test_null_score_still_fills_a_row_of_five(bodies):
    df = bodies({"result": {"data_array": [[1, "T", "kr", "x", None]]}})
    assert [r.score for r in responses.decode_hit_rows(df).collect()] == [None]


def test_hit_dicts(bodies):
    df = bodies(
        {"result": [{"metadata": {"tenant_name": "", "region": "kr", "text": "t"}, "score": "0.25"}, 5, {"score": 1}]},
        {"result": {"data_array": [[1, "T", "kr", "x", 0.5]]}},
    )
    hits = [tuple(r) for r in responses.decode_hit_dicts(df).collect()]
    assert hits == [
        (0, 1, None, "", "kr", "t", 0.25, "(unknown-tenant)"),
        (0, 2, None, None, None, "", None, "(unknown-tenant)"),
        (0, 3, None, None, None, "", 1.0, "(unknown-tenant)"),
    ]
    assert responses.decode_hits(df).count() == 4


def test_embedding_shapes_and_rejects(bodies):
    df = bodies(
        {"embeddings": [[1.0, 2], [3, 4]]},
        {"data": [{"embedding": [1, 2]}, {"embedding": [3, 4]}]},
        {"vectors": [[1, 2], [3, 4]]},
        [[1, 2], [3, 4]],
        {"data": []},
        {"other": [[1, 2]]},
        "no json",
        {"data": [{"embedding": [1, 2]}, {"text": "no vector"}]},
        {"data": [], "vectors": [[1, 2], [3, 4]]},
        [],
    )
    decoded = responses.decode_embeddings(df).collect()
    assert sorted((r.id, r.position, r.embedding) for r in decoded) == [
        (i, p, v) for i in (0, 1, 2, 3, 8) for p, v in enumerate([[1.0, 2.0], [3.0, 4.0]])
    ]
    assert sorted(r.id for r in responses.undecoded_embeddings(df).collect()) == [4, 5, 6, 7]


def test_completion_or_whole_body(bodies):
    df = bodies({"choices": [{"message": {"content": "답"}}]}, {"choices": []}, "no json")
    assert [r.answer for r in responses.decode_completion(df).collect()] == ["답", '{"choices": []}', "no json"]


def test_messages_of_every_shape(bodies):
    parts = [{"type": "text", "text": "a"}, {"type": "image", "text": "no"}, {"type": "text"}, {"type": "text", "text": "b"}]
    df = bodies(
        {"messages": [{"role": "tool", "content": "x"}, {"role": "assistant", "content": "y"}]},
        {"choices": [{"message": {"role": "assistant", "content": "[not a list]"}}]},
        {"choices": [{"message": {"role": "assistant", "content": parts}}]},
        {"choices": [{"message": {"role": "assistant", "content": None}}]},
        {"choices": [{"message": {"role": "assistant", "content": 5}}]},
        {"messages": []},
        "no json",
    )
    last = responses.last_message(responses.normalise_message(df)).collect()
    assert sorted((r.id, r.role, r.content) for r in last if r.role) == [
        (0, "assistant", "y"),
        (1, "assistant", "[not a list]"),
        (2, "assistant", "ab"),
    ]
    assert [r.id for r in last if r.role is None] == [5]
    assert sorted(r.id for r in responses.unnormalised_messages(df).collect()) == [3, 4, 6]
