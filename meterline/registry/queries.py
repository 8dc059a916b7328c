"""Every operator as a query over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline import settings as names
from meterline import sinks
from meterline.functions import models, responses, text
from meterline.operators import billing, clustered, facet_index, facets, fx, hits, measures, record_sets, usage
from meterline.operators.constraints import violations
from meterline.operators.vector_index import build_index, search_index
from meterline.operators.vectors import vector_top_k
from meterline.plans import answers, dashboard, maintained, medallion, quarantine
from meterline.registry import inputs
from meterline.session import scratch_dir, stored
from meterline.settings import Settings
from meterline.sources import files, tables
from meterline.streaming import fields as rate_fields
from meterline.streaming import fx as fx_streams
from meterline.streaming import rates as rate_streams

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SELECTED = facets.Selection(
    tenant_name=("AUTOMOBILE", "BUILDING", "HOUSEHOLD"),
    month=(1, 2, 3, 12),
    region=("ASIA", "EUROPE", "AFRICA"),
    usage_type=(facets.ALL, "F"),
)


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _view(df: DataFrame, label: str) -> str:
    name = f"meterline_{label}"
    sinks.temp_view(df, name)
    return name


# Usage records and daily totals.


@query
def scan_usage(spark, sf_dir):
    settings = Settings(source_table=_view(inputs.usage(spark, sf_dir), "usage"))
    return tables.scan_usage(spark, settings)


@query
def scan_dataset(spark, sf_dir):
    return tables.scan_dataset(spark, _view(inputs.price(spark, sf_dir), "price"))


@query
def pipeline_params(spark, sf_dir):
    """Parameters from the session conf decide the table and the tenants."""
    view = _view(inputs.usage(spark, sf_dir), "param_usage")
    given = {names.SOURCE_TABLE_KEY: view, names.TENANT_LIST_KEY: " BUILDING, ,MACHINERY,"}
    try:
        for key, value in given.items():
            spark.conf.set(key, value)
        settings = Settings.load(spark)
    finally:
        for key in given:
            spark.conf.unset(key)
    rows = medallion.bronze(tables.scan_usage(spark, settings), settings.tenants)
    return rows.groupBy("tenant_name").agg(F.count(F.lit(1)).alias("n_records"))


@query
def select_existing(spark, sf_dir):
    records = inputs.usage(spark, sf_dir).withColumn("not_wanted", F.lit(1))
    return usage.select_existing(records)


@query
def expect_or_drop(spark, sf_dir):
    return medallion.bronze(inputs.usage(spark, sf_dir), inputs.TENANTS)


@query
def record_violations(spark, sf_dir):
    return violations(inputs.usage(spark, sf_dir), usage.record_constraints(inputs.TENANTS))


@query
def tenant_in_list(spark, sf_dir):
    listed = usage.tenant_in_list(names.split_names("BUILDING, FURNITURE ,,"))
    rows = inputs.usage(spark, sf_dir)
    return rows.groupBy("tenant_name", listed.alias("listed")).agg(F.count(F.lit(1)).alias("n_records"))


@query
def normalise_date(spark, sf_dir):
    return usage.normalise_date(inputs.usage(spark, sf_dir)).select("record_id", "usage_date")


@query
def daily_usage(spark, sf_dir):
    return inputs.silver(spark, sf_dir)


@query
def daily_usage_unchecked(spark, sf_dir):
    """Daily totals of all records, before the rules on the totals."""
    return usage.daily_usage(usage.normalise_date(inputs.usage(spark, sf_dir)))


@query
def silver_violations(spark, sf_dir):
    return violations(daily_usage_unchecked(spark, sf_dir), usage.DAILY_CONSTRAINTS)


def _order_records(spark, sf_dir) -> DataFrame:
    """Checked records under their order's number, which comes back on several days."""
    records = usage.normalise_date(medallion.bronze(inputs.usage(spark, sf_dir), inputs.TENANTS))
    order = F.floor(F.col("record_id") / 10).alias("record_id")
    # Numbering and containers both read them, and each would join the tables anew.
    return stored(records.select(order, "usage_date", *usage.USAGE_KEYS), "order-records")


@query
def daily_record_sets(spark, sf_dir):
    """Distinct records per day and usage key, counted from their containers."""
    records = _order_records(spark, sf_dir)
    days = record_sets.record_sets(records, record_sets.number_records(records))
    return record_sets.count_records(days, ("usage_date", *usage.USAGE_KEYS))


@query
def distinct_records(spark, sf_dir):
    """Distinct records per tenant and region of all time, from the days' containers merged to months.

    The records of the seventeenth days come late: they are numbered after the others, and their containers are added.
    """
    records = _order_records(spark, sf_dir)
    is_late = F.coalesce(F.dayofmonth("usage_date") == 17, F.lit(False))
    first, late = records.filter(~is_late), records.filter(is_late)
    known = record_sets.number_records(first)
    every = record_sets.number_records(late, known)
    days = record_sets.record_sets(first, known).unionByName(record_sets.record_sets(late, every))
    months = record_sets.merge_record_sets(billing.year_month(days), ("year", "month", "tenant_name", "region"))
    return record_sets.count_records(months, ("tenant_name", "region"))


# Monthly totals and their price.


@query
def year_month(spark, sf_dir):
    return billing.year_month(inputs.silver(spark, sf_dir))


@query
def monthly_usage(spark, sf_dir):
    return billing.monthly_usage(year_month(spark, sf_dir))


@query
def price_lookup(spark, sf_dir):
    priced = billing.price_lookup(monthly_usage(spark, sf_dir), inputs.price(spark, sf_dir))
    return billing.price_default(priced)


@query
def estimate_cost(spark, sf_dir):
    return inputs.gold(spark, sf_dir)


@query
def gold_order(spark, sf_dir):
    return billing.gold_order(inputs.gold(spark, sf_dir))


@query
def unpriced_usage(spark, sf_dir):
    return billing.unpriced_usage(monthly_usage(spark, sf_dir), inputs.price(spark, sf_dir))


@query
def expect(spark, sf_dir):
    gold = inputs.gold(spark, sf_dir)
    report = violations(gold, billing.COST_CONSTRAINTS)
    return report.select("constraint", "n_rows", "n_failed")


# The dashboard.


@query
def query_df(spark, sf_dir):
    view = _view(inputs.gold(spark, sf_dir), "sql_gold")
    return tables.query_df(
        spark,
        f"SELECT region, year, sum(monthly_dbu) AS dbu, count(*) AS n_rows FROM {view} "
        "GROUP BY region, year",
    )


@query
def load_billing_data(spark, sf_dir):
    gold = inputs.gold(spark, sf_dir).withColumn("not_wanted", F.lit(1))
    return tables.load_billing_data(spark, Settings(gold_table=_view(gold, "gold")))


@query
def cast_period(spark, sf_dir):
    gold = inputs.gold(spark, sf_dir)
    as_text = gold.withColumns({name: F.col(name).cast("string") for name in ("year", "month")})
    return facets.cast_period(as_text)


@query
def clustered_gold(spark, sf_dir):
    """Chosen rows of the monthly table stored along a curve over tenant, region and usage type."""
    stored = clustered.write_clustered(inputs.gold(spark, sf_dir), scratch_dir(spark, "clustered-gold"))
    return facets.facet_filter(facets.cast_period(stored), SELECTED)


@query
def facet_counts(spark, sf_dir):
    """Rows of every facet value under the selection, from the bitmaps of an index."""
    index = facet_index.build_facet_index(facets.cast_period(inputs.gold(spark, sf_dir)))
    return facet_index.facet_counts(index, SELECTED)


@query
def preview(spark, sf_dir):
    """First rows, in full key order so that they are the same every time."""
    gold = inputs.gold(spark, sf_dir)
    return measures.preview(gold.orderBy("year", "month", *[F.asc_nulls_last(k) for k in usage.USAGE_KEYS]))


@query
def find_all_rows(spark, sf_dir):
    return tables.find_all_rows(spark, _view(inputs.table(spark, sf_dir, "orders"), "orders"))


@query
def facet_filter(spark, sf_dir):
    return facets.facet_filter(facets.cast_period(inputs.gold(spark, sf_dir)))


@query
def facet_filter_selected(spark, sf_dir):
    return facets.facet_filter(facets.cast_period(inputs.gold(spark, sf_dir)), SELECTED)


@query
def facet_values(spark, sf_dir):
    return facets.facet_values(inputs.gold(spark, sf_dir))


@query
def total_cost(spark, sf_dir):
    return measures.total_cost(facet_filter_selected(spark, sf_dir))


@query
def recent_cost(spark, sf_dir):
    return measures.recent_row_cost(facet_filter_selected(spark, sf_dir))


@query
def last_row(spark, sf_dir):
    """The last row of the whole table, with all its columns."""
    return measures.last_row(inputs.gold(spark, sf_dir))


@query
def last_period_cost(spark, sf_dir):
    return measures.last_period_cost(facet_filter(spark, sf_dir))


@query
def active_tenants(spark, sf_dir):
    return measures.active_tenants(facet_filter_selected(spark, sf_dir))


@query
def cost_by_tenant(spark, sf_dir):
    return measures.cost_by_tenant(facet_filter(spark, sf_dir))


@query
def kpi_row(spark, sf_dir):
    return dashboard.dashboard(inputs.gold(spark, sf_dir))["kpis"]


@query
def kpi_row_empty(spark, sf_dir):
    """An empty selection gives zeros, not NULL."""
    nothing = facets.Selection(tenant_name=())
    return dashboard.dashboard(inputs.gold(spark, sf_dir), nothing)["kpis"]


@query
def top_tenants(spark, sf_dir):
    return dashboard.dashboard(inputs.gold(spark, sf_dir), SELECTED)["cost_by_tenant"]


@query
def detail_rows(spark, sf_dir):
    return dashboard.dashboard(inputs.gold(spark, sf_dir), SELECTED)["details"]


# Exchange rates.


@query
def fx_pair_filter(spark, sf_dir):
    return inputs.pair_ticks(spark, sf_dir)


@query
def fx_latest_cost(spark, sf_dir):
    """Every monthly row at the latest rate of the pair."""
    return _plain_time(fx.cost_at_latest(inputs.gold(spark, sf_dir), inputs.pair_ticks(spark, sf_dir)))


@query
def fx_cross_join(spark, sf_dir):
    """Cost of every tenant at every tick of the pair.

    The monthly rows are summed per tenant before they meet the ticks, since the rate is a
    factor of the sum; the result has ticks x tenants rows instead of ticks x monthly rows.
    The many ticks are dealt out and the few sums copied to them.
    """
    costs, ticks = inputs.tenant_costs(spark, sf_dir), inputs.pair_ticks(spark, sf_dir)
    return fx.cost_per_tick(costs, ticks, cost_slices=1, tick_slices=16)


@query
def fx_cross_join_grid(spark, sf_dir):
    """The same with both sides dealt out."""
    costs, ticks = inputs.tenant_costs(spark, sf_dir), inputs.pair_ticks(spark, sf_dir)
    return fx.cost_per_tick(costs, ticks, cost_slices=2, tick_slices=16)


def _fx_files(spark, sf_dir) -> str:
    """All events as rate files in JSON lines."""
    folder = scratch_dir(spark, "fx-json")
    to_micros = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    inputs.ticks(spark, sf_dir).write.option("timestampNTZFormat", to_micros).json(folder)
    return folder


def _stored(spark, stream: DataFrame) -> DataFrame:
    """Run a stream over all that is there and read what it stored."""
    target = scratch_dir(spark, "appended")
    fx_streams.append_stream(stream, scratch_dir(spark, "progress"), path=target).awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)


def _plain_time(ticks: DataFrame) -> DataFrame:
    return ticks.withColumn("as_of_ts", F.col("as_of_ts").cast("timestamp_ntz"))


@query
def stream_fx_files(spark, sf_dir):
    return _plain_time(_stored(spark, fx_streams.fx_file_stream(spark, _fx_files(spark, sf_dir))))


def _fx_lines(spark, sf_dir) -> str:
    """All events as lines, those of one type with a further field and some that are no JSON."""
    folder = scratch_dir(spark, "fx-lines")
    event = inputs.table(spark, sf_dir, "events")
    rate = F.to_json(F.struct(F.lit("USD").alias("base_ccy"), F.col("value").alias("fx_rate")))
    more = F.to_json(F.struct(F.col("value").alias("fx_rate"), F.col("event_id").alias("desk")))
    bad = F.concat(F.lit("no rate "), F.col("event_id").cast("string"))
    kind = F.col("event_type")
    event.select(F.when(kind == "view", more).when(kind == "error", bad).otherwise(rate)).write.text(folder)
    return folder


@query
def stream_fx_lines(spark, sf_dir):
    folder = _fx_lines(spark, sf_dir)
    lines = _stored(spark, fx_streams.fx_line_stream(spark, folder))
    return lines.select("base_ccy", "fx_rate", "_rescued")


@query
def grown_rates(spark, sf_dir):
    """The same lines after the further field has been listed and filled in."""
    path = scratch_dir(spark, "grown")
    rate_fields.take_in(spark, _fx_lines(spark, sf_dir), path, scratch_dir(spark, "progress")).awaitTermination()
    rate_fields.grow_fields(rate_fields.stored_rates(spark, path), path)
    return rate_fields.stored_rates(spark, path).select("base_ccy", "fx_rate", "desk", "_rescued")


@query
def stream_dataset(spark, sf_dir):
    """Stored rates read as a stream, through a streaming view of one pair."""
    rates = scratch_dir(spark, "rates")
    arriving = fx_streams.fx_file_stream(spark, _fx_files(spark, sf_dir))
    fx_streams.append_stream(arriving, scratch_dir(spark, "progress"), path=rates).awaitTermination()
    stored = spark.readStream.schema(arriving.schema).parquet(rates)
    view = _view(fx.fx_pair_filter(stored), "pair_stream")
    return _plain_time(_stored(spark, fx_streams.stream_dataset(spark, view)))


@query
def append_stream(spark, sf_dir):
    """Rate files to stored costs of every tenant at every tick."""
    arriving = fx.fx_pair_filter(fx_streams.fx_file_stream(spark, _fx_files(spark, sf_dir)))
    costs = inputs.tenant_costs(spark, sf_dir)
    converted = fx_streams.stream_converted_cost(costs, arriving)
    return _plain_time(_stored(spark, converted))


@query
def stream_changed_rates(spark, sf_dir):
    """Newest tick of every currency pair, from the state of a stream over all events."""
    arriving = fx_streams.fx_file_stream(spark, _fx_files(spark, sf_dir))
    return _plain_time(_stored(spark, rate_streams.changed_rates(arriving)))


@query
def replace_stream(spark, sf_dir):
    """All rates, each micro-batch in a partition that a second run would replace."""
    arriving = fx_streams.fx_file_stream(spark, _fx_files(spark, sf_dir))
    target = scratch_dir(spark, "replaced")
    rate_streams.replace_stream(arriving, scratch_dir(spark, "progress"), path=target).awaitTermination()
    return _plain_time(spark.read.parquet(target).select(*arriving.columns))


@query
def stream_changed_cost(spark, sf_dir):
    """Rate files to the monthly costs at the newest rate: one converted copy for the one change."""
    arriving = fx.fx_pair_filter(fx_streams.fx_file_stream(spark, _fx_files(spark, sf_dir)))
    target, gold = scratch_dir(spark, "changed"), inputs.gold(spark, sf_dir)
    started = rate_streams.convert_on_change(lambda: gold, arriving, scratch_dir(spark, "progress"), path=target)
    started.awaitTermination()
    columns = [*gold.columns, *arriving.columns, "est_cost_krw"]
    return _plain_time(spark.read.parquet(target).select(*columns))


# Search.


@query
def vector_top_k_query(spark, sf_dir):
    """The benchmark's questions, broadcast."""
    chunks, questions = inputs.vectors(spark, sf_dir), inputs.questions(spark, sf_dir)
    return vector_top_k(chunks, questions, inputs.TOP_K, layout="broadcast")


QUERIES["vector_top_k"] = QUERIES.pop("vector_top_k_query")


@query
def vector_top_k_grid(spark, sf_dir):
    """Every vector asks for its neighbours, by the way for question sets too large to broadcast."""
    chunks = inputs.vectors(spark, sf_dir)
    questions = chunks.withColumnRenamed("chunk_id", "question_id")
    return vector_top_k(chunks, questions, inputs.TOP_K)


def _index(spark, sf_dir):
    return build_index(inputs.vectors(spark, sf_dir), scratch_dir(spark, "index"))


@query
def vector_index(spark, sf_dir):
    """Every chunk of the index, and whether it lies within the reach of its cluster."""
    index = _index(spark, sf_dir)
    reached = index.members.join(index.clusters, "cluster", "left")
    inside = (F.col("near") >= F.col("least")) & (F.col("n") > 0)
    return reached.select("chunk_id", inside.alias("inside"))


@query
def vector_top_k_indexed(spark, sf_dir):
    """Every vector asks the stored index for its neighbours."""
    asked = inputs.vectors(spark, sf_dir).withColumnRenamed("chunk_id", "question_id")
    return search_index(_index(spark, sf_dir), asked, inputs.TOP_K).hits


@query
def retrieve(spark, sf_dir):
    return inputs.found_chunks(spark, sf_dir).select(
        "question_id", "hit_rank", "row_id", "tenant_name", "tenant_key", "region", "chunk_text", "score"
    )


@query
def rank_hits_in_tenant(spark, sf_dir):
    ranked = hits.rank_hits_in_tenant(inputs.hits(spark, sf_dir))
    return ranked.select("question_id", "row_id", "tenant_key", "score", "tenant_rank")


@query
def best_score(spark, sf_dir):
    scored = hits.best_score(inputs.hits(spark, sf_dir))
    return scored.select("question_id", "row_id", "tenant_key", "best_score")


@query
def tenant_order(spark, sf_dir):
    ordered = hits.tenant_order(inputs.hits(spark, sf_dir))
    return ordered.select("question_id", "row_id", "tenant_key", "tenant_first")


@query
def tenant_quota(spark, sf_dir):
    counted = hits.count_tenants(inputs.hits(spark, sf_dir))
    kept = hits.tenant_quota(hits.rank_hits_in_tenant(counted))
    return kept.select("question_id", "row_id", "tenant_key", "tenant_rank", "quota")


@query
def number_context(spark, sf_dir):
    entries = hits.context_entries(inputs.hits(spark, sf_dir))
    return entries.select("question_id", "row_id", "number", "chunk")


@query
def group_citations(spark, sf_dir):
    cited = hits.group_citations(inputs.hits(spark, sf_dir))
    ids = F.transform("chunks", lambda chunk: chunk["row_id"].cast("string"))
    return cited.select(
        "question_id",
        "tenant_name",
        "tenant_first",
        "best_score",
        F.size("chunks").alias("n_chunks"),
        F.array_join(ids, ",").alias("row_ids"),
    )


@query
def flatten_citations(spark, sf_dir):
    return hits.flatten_citations(hits.group_citations(inputs.hits(spark, sf_dir)))


# Text.


@query
def trim_truncate(spark, sf_dir):
    shortened = text.trim_truncate(F.col("text"))
    return inputs.chunks(spark, sf_dir).select("chunk_id", shortened.alias("chunk"))


@query
def tag_chunk(spark, sf_dir):
    tagged = text.tag_chunk(text.tenant_key(F.col("tenant_name")), text.default_text(F.col("text")))
    return inputs.chunks(spark, sf_dir).select("chunk_id", tagged.alias("chunk"))


@query
def default_text(spark, sf_dir):
    given = text.default_text(F.col("text"))
    return inputs.chunks(spark, sf_dir).select("chunk_id", given.alias("chunk_text"))


@query
def tenant_key(spark, sf_dir):
    key = text.tenant_key(F.col("tenant_name"))
    return inputs.chunks(spark, sf_dir).select("chunk_id", "tenant_name", key.alias("tenant_key"))


@query
def safe_score(spark, sf_dir):
    """The value of events of some types is followed by letters that make it no number."""
    events = inputs.table(spark, sf_dir, "events")
    tail = F.when(F.col("event_type") == "error", "d").when(F.col("event_type") == "view", "?").otherwise("")
    given = F.concat(F.lit(" "), F.col("value").cast("string"), tail)
    return events.select("event_id", text.safe_score(given).alias("score"))


@query
def split_trim_list(spark, sf_dir):
    """Comma lists made of a part's name, brand and type with blanks and gaps."""
    parts = inputs.table(spark, sf_dir, "part")
    listed = F.concat(F.lit(" , "), "p_name", F.lit(",,\t"), "p_brand", F.lit(" ,"), "p_type", F.lit(","))
    entries = text.split_trim_list(listed)
    return parts.select("p_partkey", F.posexplode(entries).alias("position", "entry"))


@query
def join_context(spark, sf_dir):
    return hits.join_context(hits.context_entries(inputs.hits(spark, sf_dir)))


@query
def build_prompt(spark, sf_dir):
    """A prompt for every benchmark item, whose context is its own text."""
    asked = inputs.table(spark, sf_dir, "benchmark")
    context = text.number_chunk(F.col("item_id"), text.trim_truncate(F.col("text")))
    return asked.select("item_id", text.build_prompt(context, F.col("text")).alias("prompt"))


@query
def answer_prompts(spark, sf_dir):
    return answers.answer_prompts(inputs.hits(spark, sf_dir), inputs.questions(spark, sf_dir))


# Responses of services.


@query
def decode_hit_rows(spark, sf_dir):
    return responses.decode_hit_rows(inputs.hit_row_bodies(spark, sf_dir))


@query
def decode_hit_dicts(spark, sf_dir):
    return responses.decode_hit_dicts(inputs.hit_dict_bodies(spark, sf_dir)).drop("row_id")


@query
def decode_hits(spark, sf_dir):
    """Responses of both shapes in one frame."""
    both = inputs.hit_row_bodies(spark, sf_dir).union(inputs.hit_dict_bodies(spark, sf_dir))
    return responses.decode_hits(both)


@query
def decode_embeddings(spark, sf_dir):
    decoded = responses.decode_embeddings(inputs.embedding_bodies(spark, sf_dir))
    return decoded.select(
        "request_id",
        "position",
        F.posexplode("embedding").alias("dimension", "value"),
    ).withColumn("value", F.col("value").cast("double"))


@query
def undecoded_embeddings(spark, sf_dir):
    """Bodies of no known shape among those of known ones."""
    return responses.undecoded_embeddings(inputs.mixed_embedding_bodies(spark, sf_dir))


@query
def decode_completion(spark, sf_dir):
    """Text content comes out as it is, parts and whole bodies as the JSON that they are."""
    decoded = responses.decode_completion(inputs.chat_bodies(spark, sf_dir))
    parts = F.from_json("answer", "array<struct<type:string,text:string>>")
    whole = F.from_json("answer", "struct<messages:array<struct<role:string,content:string>>>")
    line = F.lit("|")
    shown = (
        F.when(F.col("turn") % 3 == 1, F.array_join(F.transform(parts, lambda p: F.concat(p.type, line, p.text)), "|"))
        .when(
            F.col("turn") % 3 == 2,
            F.array_join(F.transform(whole.messages, lambda m: F.concat(m.role, line, m.content)), "|"),
        )
        .otherwise(F.col("answer"))
    )
    return decoded.select("conv_id", "turn", shown.alias("answer"))


@query
def unnormalised_messages(spark, sf_dir):
    """Bodies without messages or choices among chat responses."""
    return responses.unnormalised_messages(inputs.mixed_chat_bodies(spark, sf_dir))


@query
def normalise_message(spark, sf_dir):
    normalised = responses.normalise_message(inputs.chat_bodies(spark, sf_dir))
    return normalised.select("conv_id", "turn", F.posexplode("messages").alias("position", "message")).select(
        "conv_id", "turn", "position", "message.role", "message.content"
    )


@query
def last_message(spark, sf_dir):
    return responses.last_message(responses.normalise_message(inputs.chat_bodies(spark, sf_dir)))


@query
def last_turn(spark, sf_dir):
    """Last message of every conversation."""
    turns = inputs.table(spark, sf_dir, "conversations")
    last = F.max_by(F.struct("role", "text"), "turn")
    return turns.groupBy("conv_id").agg(last.alias("last")).select("conv_id", "last.role", "last.text")


# Models.


@query
def embed_texts(spark, sf_dir):
    """Hashed vectors of all documents; shown are their size and length."""
    embedded = models.embed_texts(inputs.table(spark, sf_dir, "documents"), "text")
    square = F.aggregate("embedding", F.lit(0.0), lambda total, x: total + x.cast("double") * x)
    return embedded.select(
        "doc_id", F.size("embedding").alias("dimensions"), F.round(F.sqrt(square), 3).alias("length")
    )


@query
def embedded_words(spark, sf_dir):
    """Words in each entry of the hashed vectors: a unit vector times its words, divided by the sum of its entries."""
    embedded = models.embed_texts(inputs.table(spark, sf_dir, "documents"), "text")
    n_words = F.regexp_count(F.lower("text"), F.lit(r"(?U)\w+"))
    total = F.aggregate("embedding", F.lit(0.0), lambda total, x: total + x.cast("double"))
    # Per text, in a select of its own: beside a generator Spark would work these out for every entry again.
    measured = embedded.select("doc_id", n_words.alias("n"), total.alias("total"), "embedding")
    entries = measured.select("doc_id", "n", "total", F.posexplode("embedding").alias("entry", "value"))
    counted = F.round(F.col("value").cast("double") * F.col("n") / F.col("total")).cast("long")
    return entries.filter("value > 0").select("doc_id", "entry", counted.alias("n_words"))


def _counting_chat():
    """A stand-in for a chat service: answers with the lengths of what it was sent."""

    def chat(talks, temperature):
        import json

        lengths = [",".join(str(len(one["content"])) for one in talk) for talk in talks]
        return [json.dumps({"choices": [{"message": {"content": f"{n}@{temperature}"}}]}) for n in lengths]

    return chat


@query
def generate(spark, sf_dir):
    prompts = answer_prompts(spark, sf_dir)
    answered = models.generate(prompts, _counting_chat(), system_text="four")
    return answered.select("question_id", "answer")


# Stores.


@query
def materialize(spark, sf_dir):
    """The monthly table, stored by year and month in a schema of its own and read by name."""
    schema = f"meterline_{scratch_dir(spark, 'db').rsplit('-', 1)[1]}"
    spark.sql(f"CREATE DATABASE {schema} LOCATION '{scratch_dir(spark, 'schema')}'")
    stored = sinks.materialize(
        inputs.gold(spark, sf_dir),
        f"{schema}.{names.GOLD_TABLE}",
        comment="Monthly usage and cost",
        properties={sinks.RESET_ALLOWED: "false"},
        partition_by=("year", "month"),
        sort_by=("tenant_name", "sku_name"),
    )
    return stored.select(*billing.GOLD_COLUMNS)


@query
def refresh_report(spark, sf_dir):
    """Rules of a full refresh into a schema of its own."""
    schema = f"meterline_{scratch_dir(spark, 'db').rsplit('-', 1)[1]}"
    spark.sql(f"CREATE DATABASE {schema} LOCATION '{scratch_dir(spark, 'schema')}'")
    settings = Settings(f"{schema}.usage_records", inputs.TENANTS, schema=schema)
    sinks.materialize(inputs.usage(spark, sf_dir), settings.source_table)
    sinks.materialize(inputs.price(spark, sf_dir), settings.qualified(settings.price_table))
    return medallion.refresh_reported(spark, settings).report


@query
def absorbed_gold(spark, sf_dir):
    """The monthly table after a refresh without some of the records, which then come late."""
    schema = f"meterline_{scratch_dir(spark, 'db').rsplit('-', 1)[1]}"
    spark.sql(f"CREATE DATABASE {schema} LOCATION '{scratch_dir(spark, 'schema')}'")
    settings = Settings(f"{schema}.usage_records", inputs.TENANTS, schema=schema)
    every = sinks.materialize(inputs.usage(spark, sf_dir), f"{schema}.all_records")
    comes_late = F.coalesce(F.dayofmonth("usage_date") == 17, F.lit(False)) & (F.col("record_id") % 3 == 0)
    sinks.materialize(every.filter(~comes_late), settings.source_table)
    sinks.materialize(inputs.price(spark, sf_dir), settings.qualified(settings.price_table))
    medallion.refresh(spark, settings)
    return maintained.absorb(spark, every.filter(comes_late), settings)


@query
def use_namespace(spark, sf_dir):
    """Prices stored in a schema and read by an unqualified name."""
    schema = f"meterline_{scratch_dir(spark, 'db').rsplit('-', 1)[1]}"
    spark.sql(f"CREATE DATABASE {schema} LOCATION '{scratch_dir(spark, 'schema')}'")
    before = spark.catalog.currentDatabase()
    sinks.materialize(inputs.price(spark, sf_dir), f"{schema}.{names.PRICE_TABLE}")
    tables.use_namespace(spark, schema=schema)
    try:
        return tables.scan_dataset(spark, names.PRICE_TABLE)
    finally:
        tables.use_namespace(spark, schema=before)


@query
def reset_guard(spark, sf_dir):
    """Rows of a guarded table after a refused reset and an allowed refresh."""
    schema = f"meterline_{scratch_dir(spark, 'db').rsplit('-', 1)[1]}"
    spark.sql(f"CREATE DATABASE {schema} LOCATION '{scratch_dir(spark, 'schema')}'")
    name, guard = f"{schema}.{names.BRONZE_TABLE}", {sinks.RESET_ALLOWED: "false"}
    rows = inputs.price(spark, sf_dir)
    sinks.materialize(rows, name, properties=guard)
    try:
        sinks.materialize(rows, name, properties=guard, reset=True)
        refused = False
    except sinks.ResetNotAllowed:
        refused = True
    refreshed = sinks.materialize(rows, name, properties=guard)
    return refreshed.groupBy(F.lit(refused).alias("refused")).agg(F.count(F.lit(1)).alias("n_rows"))


@query
def temp_view(spark, sf_dir):
    view = _view(inputs.gold(spark, sf_dir), "monthly_usd")
    return spark.read.table(view)


@query
def load_fixture(spark, sf_dir):
    """Customers written as CSV and read back: text columns only."""
    folder = scratch_dir(spark, "fixture") + ".csv"
    inputs.table(spark, sf_dir, "customer").write.option("header", True).csv(folder)
    return files.load_fixture(spark, folder)



@query
def load_fixture_json(spark, sf_dir):
    """Suppliers written as lists of JSON records, a file for each nation, and read back with the types found."""
    folder = scratch_dir(spark, "fixture") + ".json"
    suppliers = inputs.table(spark, sf_dir, "supplier")
    record = F.struct(*suppliers.columns)
    listed = suppliers.groupBy(F.col("s_nationkey").alias("nation")).agg(F.to_json(F.collect_list(record)).alias("value"))
    listed.write.partitionBy("nation").text(folder)
    return files.load_fixture(spark, folder).select(*suppliers.columns)


# Rows that break rules.


def _split_usage(spark, sf_dir) -> tuple[quarantine.Split, str]:
    schema = f"meterline_{scratch_dir(spark, 'db').rsplit('-', 1)[1]}"
    spark.sql(f"CREATE DATABASE {schema} LOCATION '{scratch_dir(spark, 'schema')}'")
    rules = usage.record_constraints(inputs.TENANTS)
    records = usage.select_existing(inputs.usage(spark, sf_dir))
    return quarantine.store_split(records, rules, f"{schema}.judged_usage"), schema


@query
def quarantined(spark, sf_dir):
    """Usage records that the rules reject, with the names of those they break."""
    split, _ = _split_usage(spark, sf_dir)
    return split.rejected.withColumn(quarantine.BROKEN, F.array_join(quarantine.BROKEN, ","))


@query
def kept_after_quarantine(spark, sf_dir):
    """Usage records that no rule rejects, from the same pass."""
    return _split_usage(spark, sf_dir)[0].kept


@query
def rule_history(spark, sf_dir):
    """Counts of two refreshes, the second of which is recorded twice."""
    split, schema = _split_usage(spark, sf_dir)
    rules = usage.record_constraints(inputs.TENANTS)
    for refresh_id in ("1", "2", "2"):
        counts = quarantine.rule_counts(split, rules, "bronze", refresh_id)
        stored = quarantine.record_history(counts, f"{schema}.rule_history")
    return stored.select("refresh_id", "stage", "constraint", "action", "n_rows", "n_failed")
