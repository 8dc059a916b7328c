"""The plans that large inputs depend on."""

from pyspark.sql import functions as F

from meterline.plans import answers
from meterline.registry import inputs
from meterline.registry.queries import QUERIES
from tests.conftest import SF_DIR


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rules_reach_the_scan(spark):
    text = plan(QUERIES["daily_usage"](spark, SF_DIR))
    assert "In(c_mktsegment, [AUTOMOBILE,BUILDING,FURNITURE,HOUSEHOLD])" in text
    below_joins = text[text.rindex("Exchange hashpartitioning(l_orderkey") :]
    assert any("Filter" in line and ">= 0.0)" in line for line in below_joins.splitlines()[:3])
    assert "l_tax" not in text and "o_totalprice" not in text


def test_distinct_count_is_spread_by_record(spark):
    text = plan(QUERIES["daily_usage"](spark, SF_DIR))
    exchanges = [line for line in text.splitlines() if "Exchange hashpartitioning(usage_date" in line]
    assert len(exchanges) == 2 and sum("record_id" in line for line in exchanges) == 1


def test_search_shuffles_hits_not_texts(spark):
    """Texts are filtered by the stored hits where they are read, before any exchange."""
    none = F.lit(None).cast("string")
    documents = inputs.table(spark, SF_DIR, "documents")
    chunks = documents.select(
        F.col("doc_id").alias("chunk_id"), none.alias("tenant_name"), none.alias("region"), "text"
    )
    found = answers.search(
        chunks, inputs.questions(spark, SF_DIR), vectors=inputs.vectors(spark, SF_DIR)
    )
    text = plan(found)
    scan = text.index("ReadSchema: struct<doc_id:bigint,text:string>")
    above_scan = text[text.index("LeftSemi") : scan]
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in above_scan

def test_context_needs_one_shuffle_of_the_hits(spark):
    from meterline.operators import hits as steps

    schema = "question_id long, hit_rank int, row_id string, tenant_name string, region string, chunk_text string, score double"
    hits = steps.as_hits(spark.createDataFrame([], schema))
    text = plan(steps.join_context(steps.context_entries(hits)))
    assert text.count("Exchange hashpartitioning") == 1
