"""Questions to retrieved chunks, citations and prompts, for a table of questions."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Literal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.functions.models import ChatFunction, EmbedFunction, embed_texts, generate
from meterline.functions.text import SYSTEM_TEXT, build_prompt
from meterline.operators import hits as hit_steps
from meterline.operators.vectors import vector_top_k
from meterline.session import stored
from meterline.settings import DEFAULT_HIT_COLUMNS, DEFAULT_TOP_K, split_names

HIT_COLUMNS = split_names(DEFAULT_HIT_COLUMNS)


def search(
    chunks: DataFrame,
    questions: DataFrame,
    k: int = DEFAULT_TOP_K,
    vectors: DataFrame | None = None,
    columns: Sequence[str] = HIT_COLUMNS,
    layout: Literal["grid", "broadcast"] = "grid",
) -> DataFrame:
    """Hits of each question: ``question_id, hit_rank, row_id, score`` and the chunk's columns.

    ``columns`` names the id, tenant, region and text of the chunk table. The search itself
    reads ids and vectors, from ``vectors`` if they are stored apart. Its results are stored, so
    Spark knows how many bytes they are: up to its broadcast threshold the texts are filtered
    where they are read and only those of hits are shuffled. A hit without a text row is kept
    with NULL text.
    """
    chunk_id, tenant, region, text = columns
    searched = chunks if vectors is None else vectors
    found = stored(vector_top_k(searched, questions, k, chunk_id, layout=layout), "hits")
    texts = chunks.select(
        chunk_id,
        F.col(tenant).alias("tenant_name"),
        F.col(region).alias("region"),
        F.col(text).alias("chunk_text"),
    )
    needed = texts.join(found.select(chunk_id).distinct(), chunk_id, "left_semi")
    return found.join(needed, chunk_id, "left").withColumnRenamed(chunk_id, "row_id")


def retrieve(
    chunks: DataFrame,
    questions: DataFrame,
    k: int = DEFAULT_TOP_K,
    embed: EmbedFunction | None = None,
    vectors: DataFrame | None = None,
    columns: Sequence[str] = HIT_COLUMNS,
    layout: Literal["grid", "broadcast"] = "grid",
) -> DataFrame:
    """Hits with tenant key and text; questions without vectors get them from ``embed``.

    The vectors are stored before they are searched, so ``embed`` sees each question once.
    """
    if "embedding" not in questions.columns:
        questions = stored(embed_texts(questions, "question", embed), "questions")
    return hit_steps.as_hits(search(chunks, questions, k, vectors, columns, layout))


def answer_prompts(
    hits: DataFrame, questions: DataFrame, system_text: str = SYSTEM_TEXT
) -> DataFrame:
    """The prompt of every question; one without hits has an empty context."""
    contexts = hit_steps.join_context(hit_steps.context_entries(hits))
    asked = questions.select("question_id", "question").join(contexts, "question_id", "left")
    context = F.coalesce("context", F.lit(""))
    return asked.select(
        "question_id",
        build_prompt(context, F.col("question"), system_text).alias("prompt"),
        F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"),
    )


def answer(
    chunks: DataFrame,
    questions: DataFrame,
    chat: ChatFunction,
    k: int = DEFAULT_TOP_K,
    embed: EmbedFunction | None = None,
    vectors: DataFrame | None = None,
    columns: Sequence[str] = HIT_COLUMNS,
    layout: Literal["grid", "broadcast"] = "grid",
) -> tuple[DataFrame, DataFrame]:
    """Answers and citations of all questions, from hits that are found and stored once."""
    hits = stored(retrieve(chunks, questions, k, embed, vectors, columns, layout), "answer-hits")
    answers = generate(answer_prompts(hits, questions), chat)
    return answers.select("question_id", "answer"), hit_steps.group_citations(hits)
