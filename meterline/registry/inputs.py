"""Billing inputs derived from the test tables, from all their rows and whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.operators.fx import fx_pair_filter
from meterline.operators.measures import cost_by_tenant
from meterline.plans import answers, medallion

TENANTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD")
# The five rows of the region table, in the order of their keys from 0.
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
TOP_K = 5
VECTORS_PER_BODY = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _node_type() -> Column:
    size = F.col("p_size")
    return F.when(size % 10 == 0, F.lit(None)).when(size <= 25, "small").otherwise("large")


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One usage record per line item, without the optional columns.

    Orders meet their customers before the lines, so that the lines are shuffled once. That
    join is of two large tables and is hinted as a sort-merge join, which spills and whose
    skewed partitions Spark splits; the other tables are left to Spark's size check.
    """
    read = lambda name: table(spark, sf_dir, name)
    places = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    payers = read("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    bought = read("orders").join(payers, F.col("o_custkey") == F.col("c_custkey"))
    lines = read("lineitem").join(bought.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.join(read("part"), F.col("l_partkey") == F.col("p_partkey")).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("record_id"),
        F.col("c_mktsegment").alias("tenant_name"),
        F.col("p_type").alias("sku_name"),
        F.col("l_shipdate").alias("usage_date"),
        F.when(F.col("l_returnflag") == "R", "GB").otherwise("DBU").alias("usage_unit"),
        F.col("l_quantity").alias("usage_quantity"),
        F.col("l_linestatus").alias("usage_type"),
        _node_type().alias("node_type"),
        F.col("r_name").alias("region"),
    )


def price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A price per part type, region and node type; promotions have none in one region."""
    sizes = (
        table(spark, sf_dir, "part")
        .groupBy(F.col("p_type").alias("sku_name"), _node_type().alias("node_type"))
        .agg(F.min("p_size").alias("least"), F.sum("p_size").alias("total"))
    )
    regions = F.array(*[F.lit(name) for name in REGIONS])
    priced = sizes.select("*", F.posexplode(regions).alias("region_key", "region"))
    listed = ~((F.col("region") == "AFRICA") & (F.col("sku_name") == "PROMO"))
    points = F.col("least") + F.col("total") % 7 + F.col("region_key")
    return priced.filter(listed).select(
        "sku_name", "region", "node_type", (points / 64.0).alias("usd_per_dbu")
    )


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return medallion.silver(medallion.bronze(usage(spark, sf_dir), TENANTS))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return medallion.gold(silver(spark, sf_dir), price(spark, sf_dir))


def tenant_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost_by_tenant(gold(spark, sf_dir))


def to_ticks(events: DataFrame) -> DataFrame:
    """Events as rate records; works on a stream of events too."""
    kind = F.col("event_type")
    return events.select(
        F.col("ts").alias("as_of_ts"),
        F.when(kind == "error", "EUR").otherwise("USD").alias("base_ccy"),
        F.when(kind == "purchase", "KRW").when(kind == "view", "JPY").otherwise("EUR").alias("quote_ccy"),
        F.col("value").alias("fx_rate"),
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_ticks(table(spark, sf_dir, "events"))


def pair_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx_pair_filter(ticks(spark, sf_dir))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk for each document and each vector, matched by id, with the document's whole text.

    A document without a vector has no tenant; a vector without a document has no text.
    """
    labels, documents = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents")
    regions = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("region"))
    label = F.col("label")
    named = F.when(label == 4, F.lit(None)).when(label == 5, "")
    for number, tenant in enumerate(TENANTS):
        named = named.when(label == number, tenant)
    tenant_name = named.otherwise(F.concat(F.lit("TENANT_"), label.cast("string")))
    same = F.col("vec_id") == F.col("doc_id")
    joined = documents.select("doc_id", "text").join(labels.select("vec_id", "label"), same, "full")
    return joined.join(regions, label % 5 == F.col("r_regionkey"), "left").select(
        F.coalesce("doc_id", "vec_id").alias("chunk_id"),
        tenant_name.alias("tenant_name"),
        "region",
        F.concat(F.lit("  "), F.col("text"), F.lit("\n")).alias("text"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and vectors of the chunks, which are stored apart from their texts."""
    stored = table(spark, sf_dir, "embeddings")
    return stored.select(F.col("vec_id").alias("chunk_id"), "embedding")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item as a question, with the vector of its id where there is one."""
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return asked.join(vectors, F.col("item_id") == F.col("vec_id"), "left").select(
        F.col("item_id").alias("question_id"), "question", "embedding"
    )


def found_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.retrieve(
        chunks(spark, sf_dir), questions(spark, sf_dir), TOP_K, vectors=vectors(spark, sf_dir)
    )


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of every question; every seventh chunk id has lost its score."""
    found = found_chunks(spark, sf_dir)
    return found.withColumn("score", F.when(F.col("row_id") % 7 != 0, F.col("score")))


def _as_array(row: Column) -> Column:
    """A hit as a JSON array; odd chunk ids get a sixth entry, which is to be ignored."""
    fields = ("row_id", "tenant_name", "region", "chunk_text", "score")
    entries = F.array(*[row[name].cast("variant") for name in fields])
    extra = F.array(F.lit("extra").cast("variant"))
    return F.when(row["row_id"] % 2 == 1, F.concat(entries, extra)).otherwise(entries)


def _hit_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.struct("hit_rank", "row_id", "tenant_name", "region", "chunk_text", "score")
    listed = F.array_sort(F.collect_list(hit)).alias("hits")
    return hits(spark, sf_dir).groupBy("question_id").agg(listed)


def hit_row_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search response per question with positional rows, the last of them too short."""
    short = F.array(F.array(*[F.lit(word).cast("variant") for word in ("id", "t", "r", "text")]))
    rows = F.concat(F.transform("hits", _as_array), short)
    result = F.struct(F.struct(F.size(rows).alias("row_count"), rows.alias("data_array")).alias("result"))
    return _hit_lists(spark, sf_dir).select("question_id", F.to_json(result).alias("body"))


def hit_dict_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search response per question in the older shape of objects with metadata."""
    as_object = lambda hit: F.struct(
        F.struct(hit["tenant_name"].alias("tenant_name"), hit["region"].alias("region"), hit["chunk_text"].alias("text")).alias("metadata"),
        hit["score"].alias("score"),
    )
    result = F.struct(F.transform("hits", as_object).alias("result"))
    return _hit_lists(spark, sf_dir).select("question_id", F.to_json(result).alias("body"))


def embedding_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding responses of eight vectors each, in the four shapes by turns."""
    request = F.floor(F.col("vec_id") / VECTORS_PER_BODY).alias("request_id")
    listed = F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("listed")
    requests = table(spark, sf_dir, "embeddings").groupBy(request).agg(listed)
    vectors = F.transform("listed", lambda one: one["embedding"])
    data = F.transform("listed", lambda one: F.struct(one["embedding"].alias("embedding")))
    turn = F.col("request_id") % 4
    body = (
        F.when(turn == 0, F.to_json(F.struct(vectors.alias("embeddings"))))
        .when(turn == 1, F.to_json(F.struct(data.alias("data"))))
        .when(turn == 2, F.to_json(F.struct(vectors.alias("vectors"))))
        .otherwise(F.to_json(vectors))
    )
    return requests.select("request_id", body.alias("body"))


def chat_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chat response per turn: text content, content in parts, or a list of messages."""
    text, role = F.col("text"), F.col("role")
    half = F.floor(F.length(text) / 2).cast("int")
    part = lambda kind, words: F.struct(F.lit(kind).alias("type"), words.alias("text"))
    parts = F.array(
        part("text", F.substring(text, F.lit(1), half)),
        part("image", F.lit("not text")),
        part("text", F.substring(text, half + 1, F.length(text))),
    )
    message = lambda content: F.struct(role.alias("role"), content.alias("content"))
    choice = lambda content: F.to_json(
        F.struct(F.array(F.struct(message(content).alias("message"))).alias("choices"))
    )
    before = F.struct(F.lit("tool").alias("role"), F.lit("looked up").alias("content"))
    several = F.to_json(F.struct(F.array(before, message(text)).alias("messages")))
    shape = F.col("turn") % 3
    body = F.when(shape == 0, choice(text)).when(shape == 1, choice(parts)).otherwise(several)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", body.alias("body"))


def mixed_embedding_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding responses, every third of which has its vectors under an unknown name."""
    bodies = embedding_bodies(spark, sf_dir)
    unknown = F.concat(F.lit('{"points": '), F.col("request_id").cast("string"), F.lit("}"))
    return bodies.select("request_id", F.when(F.col("request_id") % 3 == 0, unknown).otherwise(F.col("body")).alias("body"))


def mixed_chat_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat responses, those of assistants without choices."""
    bodies = chat_bodies(spark, sf_dir).join(
        table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id", "turn"]
    )
    unknown = F.concat(F.lit('{"error": '), F.col("turn").cast("string"), F.lit("}"))
    body = F.when(F.col("role") == "assistant", unknown).otherwise(F.col("body"))
    return bodies.select("conv_id", "turn", body.alias("body"))
