"""Search hits per question: rank within tenant, quota, numbered context and citations.

A question has at most k hits (the k of its search), so the groups formed here are small.
All windows share one partitioning by question and need one shuffle at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from meterline.functions.text import (
    default_text,
    number_chunk,
    tag_chunk,
    tenant_key,
    trim_truncate,
)

# Chunks in one context, and the number of its first chunk.
CONTEXT_CHUNKS = 6
FIRST_NUMBER = 2


def _question() -> WindowSpec:
    return Window.partitionBy("question_id")


def _tenant() -> WindowSpec:
    return Window.partitionBy("question_id", "tenant_key")


def as_hits(found: DataFrame) -> DataFrame:
    """Give search results the columns that the steps below use."""
    return found.withColumns(
        {
            "tenant_key": tenant_key(F.col("tenant_name")),
            "chunk_text": default_text(F.col("chunk_text")),
        }
    )


def count_tenants(hits: DataFrame) -> DataFrame:
    """``n_tenants`` of the question.

    Done first, it leaves the hits partitioned by question, which the windows by question
    and tenant reuse; search results that are partitioned so already are not shuffled.
    """
    return hits.withColumn("n_tenants", F.size(F.collect_set("tenant_key").over(_question())))


def rank_hits_in_tenant(hits: DataFrame) -> DataFrame:
    """``tenant_rank`` by falling score, missing scores last, ties in arrival order."""
    order = _tenant().orderBy(F.desc_nulls_last("score"), "hit_rank")
    return hits.withColumn("tenant_rank", F.row_number().over(order))


def best_score(hits: DataFrame) -> DataFrame:
    """Best score of the tenant, NULL where it has none."""
    return hits.withColumn("best_score", F.max("score").over(_tenant()))


def tenant_order(hits: DataFrame) -> DataFrame:
    """``tenant_first``: place of the tenant's first hit, the order in which tenants appear."""
    return hits.withColumn("tenant_first", F.min("hit_rank").over(_tenant()))


def tenant_quota(hits: DataFrame, context_chunks: int = CONTEXT_CHUNKS) -> DataFrame:
    """Keep an equal share of the context per tenant, at least one chunk."""
    share = F.greatest(F.lit(1), F.floor(F.lit(context_chunks) / F.col("n_tenants")))
    shared = hits.withColumn("quota", share.cast("int"))
    return shared.filter(F.col("tenant_rank") <= F.col("quota"))


def number_context(hits: DataFrame, first_number: int = FIRST_NUMBER) -> DataFrame:
    """Number the chunks over tenants in order of appearance, then by rank."""
    order = _question().orderBy("tenant_first", "tenant_rank")
    return hits.withColumn("number", F.row_number().over(order) + (first_number - 1))


def context_entries(
    hits: DataFrame, context_chunks: int = CONTEXT_CHUNKS, first_number: int = FIRST_NUMBER
) -> DataFrame:
    """The numbered, shortened and tagged chunks that make up each question's context."""
    ranked = tenant_order(rank_hits_in_tenant(count_tenants(hits)))
    numbered = number_context(tenant_quota(ranked, context_chunks), first_number)
    chunk = tag_chunk(F.col("tenant_key"), trim_truncate(F.col("chunk_text")))
    return numbered.withColumn("chunk", chunk)


def join_context(entries: DataFrame) -> DataFrame:
    """One context per question: its entries in order, parted by a blank line."""
    entry = F.struct("number", number_chunk(F.col("number"), F.col("chunk")).alias("entry"))
    in_order = F.array_sort(F.collect_list(entry))
    return entries.groupBy("question_id").agg(
        F.array_join(F.transform(in_order, lambda e: e["entry"]), "\n\n").alias("context"),
        F.count(F.lit(1)).alias("n_chunks"),
    )


def group_citations(hits: DataFrame) -> DataFrame:
    """One citation per question and tenant, with all its hits in rank order.

    ``tenant_name`` of the citation is the key (with the stand-in for a missing name); each
    chunk keeps the name it came with.
    """
    ranked = tenant_order(rank_hits_in_tenant(hits))
    chunk = F.struct("tenant_rank", "row_id", "chunk_text", "tenant_name", "region", "score")
    grouped = ranked.groupBy("question_id", "tenant_key").agg(
        F.max("score").alias("best_score"),
        F.first("tenant_first").alias("tenant_first"),
        F.array_sort(F.collect_list(chunk)).alias("chunks"),
    )
    return grouped.select(
        "question_id", F.col("tenant_key").alias("tenant_name"), "tenant_first", "best_score", "chunks"
    )


def flatten_citations(citations: DataFrame) -> DataFrame:
    """One row per cited chunk. The name of the chunk replaces that of the citation."""
    return citations.select(
        "question_id", "best_score", "tenant_first", F.explode("chunks").alias("chunk")
    ).select("question_id", "best_score", "tenant_first", "chunk.*")
