"""The same queries in DuckDB SQL over the test tables, written independently of Spark."""

from __future__ import annotations

# Fixed values, spelled out here so that a wrong one in the library is seen.
SYSTEM_TEXT = (
    "You are a tenant-billing analyst.\n"
    "Explain monthly usage and cost per tenant in clear English, "
    "and focus on business insights (spikes, anomalies, top SKUs, regions).\n"
)
CONTEXT_HEADING = "# Context (tenant monthly usage rows)\n"
QUESTION_HEADING = "# User question\n"
CLOSING = "# Answer in business terms, focusing on tenant-level usage & cost insights.\n"
WHITESPACE_CODES = (
    *range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288
)

_KEYS = "tenant_name, sku_name, usage_type, usage_unit, region, node_type"
_GOLD = f"year, month, {_KEYS}, monthly_dbu, est_cost_usd, monthly_records"
_SPACES = " || ".join(f"chr({code})" for code in WHITESPACE_CODES)


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# Named subqueries, each with the ones it needs.
_NODE = "CASE WHEN p_size % 10 = 0 THEN NULL WHEN p_size <= 25 THEN 'small' ELSE 'large' END"
_PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "usage": (
        (),
        f"""SELECT l_orderkey * 10 + l_linenumber AS record_id, c_mktsegment AS tenant_name,
        p_type AS sku_name, l_shipdate AS usage_date,
        CASE WHEN l_returnflag = 'R' THEN 'GB' ELSE 'DBU' END AS usage_unit,
        l_quantity AS usage_quantity, l_linestatus AS usage_type, {_NODE} AS node_type,
        r_name AS region
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey""",
    ),
    "price": (
        (),
        f"""SELECT p_type AS sku_name, r_name AS region, {_NODE} AS node_type,
        (min(p_size) + sum(p_size) % 7 + min(r_regionkey)) / 64.0::DOUBLE AS usd_per_dbu
        FROM part CROSS JOIN region WHERE NOT (r_name = 'AFRICA' AND p_type = 'PROMO')
        GROUP BY ALL""",
    ),
    "bronze": (
        ("usage",),
        """SELECT * FROM usage WHERE record_id IS NOT NULL AND usage_quantity >= 0
        AND tenant_name IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD')""",
    ),
    "daily_all": (
        ("usage",),
        f"""SELECT CAST(usage_date AS DATE) AS usage_date, {_KEYS},
        sum(usage_quantity) AS total_dbu, count(DISTINCT record_id) AS record_cnt
        FROM usage GROUP BY ALL""",
    ),
    "daily": (
        ("bronze",),
        f"""SELECT CAST(usage_date AS DATE) AS usage_date, {_KEYS},
        sum(usage_quantity) AS total_dbu FROM bronze GROUP BY ALL""",
    ),
    "silver": (
        ("bronze",),
        f"""SELECT CAST(usage_date AS DATE) AS usage_date, {_KEYS},
        sum(usage_quantity) AS total_dbu, count(DISTINCT record_id) AS record_cnt
        FROM bronze GROUP BY ALL
        HAVING usage_unit = 'DBU' AND sum(usage_quantity) > 0 AND tenant_name IS NOT NULL
        AND CAST(usage_date AS DATE) IS NOT NULL""",
    ),
    "monthly": (
        ("silver",),
        f"""SELECT CAST(year(usage_date) AS INTEGER) AS year,
        CAST(month(usage_date) AS INTEGER) AS month, {_KEYS},
        sum(total_dbu) AS monthly_dbu, CAST(sum(record_cnt) AS BIGINT) AS monthly_records
        FROM silver GROUP BY ALL""",
    ),
    "priced": (
        ("monthly", "price"),
        """SELECT m.*, coalesce(p.usd_per_dbu, 0.0::DOUBLE) AS usd_per_dbu
        FROM monthly m LEFT JOIN price p ON m.sku_name = p.sku_name AND m.region = p.region
        AND m.node_type = p.node_type""",
    ),
    "gold": (
        ("priced",),
        f"""SELECT year, month, {_KEYS}, monthly_dbu,
        monthly_dbu * usd_per_dbu AS est_cost_usd, monthly_records FROM priced""",
    ),
    "chosen": (
        ("gold",),
        """SELECT * FROM gold WHERE tenant_name IS NOT NULL AND year IS NOT NULL
        AND month IS NOT NULL AND region IS NOT NULL AND usage_type IS NOT NULL""",
    ),
    "selected": (
        ("gold",),
        """SELECT * FROM gold WHERE tenant_name IN ('AUTOMOBILE', 'BUILDING', 'HOUSEHOLD')
        AND year IS NOT NULL AND month IN (1, 2, 3, 12)
        AND region IN ('ASIA', 'EUROPE', 'AFRICA') AND usage_type IS NOT NULL""",
    ),
    "ticks": (
        (),
        """SELECT event_id, ts AS as_of_ts,
        CASE WHEN event_type = 'error' THEN 'EUR' ELSE 'USD' END AS base_ccy,
        CASE event_type WHEN 'purchase' THEN 'KRW' WHEN 'view' THEN 'JPY' ELSE 'EUR' END
        AS quote_ccy, value AS fx_rate FROM events""",
    ),
    "pair_ticks": (
        ("ticks",),
        "SELECT * FROM ticks WHERE base_ccy = 'USD' AND quote_ccy = 'KRW'",
    ),
    "krw": (
        ("gold", "pair_ticks"),
        """SELECT any_value(as_of_ts) AS as_of_ts, any_value(base_ccy) AS base_ccy,
        any_value(quote_ccy) AS quote_ccy, any_value(fx_rate) AS fx_rate, tenant_name,
        sum(est_cost_usd) AS est_cost_usd,
        sum(est_cost_usd) * any_value(fx_rate) AS est_cost_krw
        FROM gold CROSS JOIN pair_ticks GROUP BY event_id, tenant_name""",
    ),
    "chunks": (
        (),
        """SELECT coalesce(doc_id, vec_id) AS chunk_id, CASE WHEN label = 0 THEN 'AUTOMOBILE'
        WHEN label = 1 THEN 'BUILDING' WHEN label = 2 THEN 'FURNITURE'
        WHEN label = 3 THEN 'HOUSEHOLD' WHEN label = 4 THEN NULL WHEN label = 5 THEN ''
        ELSE 'TENANT_' || label END AS tenant_name, r_name AS region,
        '  ' || text || chr(10) AS text, CAST(embedding AS DOUBLE[]) AS embedding
        FROM embeddings FULL JOIN documents ON vec_id = doc_id
        LEFT JOIN region ON label % 5 = r_regionkey""",
    ),
    "questions": (
        (),
        """SELECT item_id AS question_id, text AS question,
        CAST(embedding AS DOUBLE[]) AS embedding
        FROM benchmark LEFT JOIN embeddings ON item_id = vec_id""",
    ),
    "found": (
        ("chunks", "questions"),
        """SELECT question_id, chunk_id, score, CAST(row_number() OVER
        (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS INTEGER) AS hit_rank
        FROM (SELECT question_id, chunk_id,
        round(list_cosine_similarity(q.embedding, c.embedding), 6) AS score
        FROM questions q CROSS JOIN chunks c
        WHERE q.embedding IS NOT NULL AND c.embedding IS NOT NULL) QUALIFY hit_rank <= 5""",
    ),
    "scored": (
        ("found", "chunks"),
        """SELECT question_id, hit_rank, chunk_id AS row_id, tenant_name,
        coalesce(nullif(tenant_name, ''), '(unknown-tenant)') AS tenant_key, region,
        coalesce(text, '') AS chunk_text, score FROM found JOIN chunks USING (chunk_id)""",
    ),
    "hits": (
        ("scored",),
        """SELECT * REPLACE (CASE WHEN row_id % 7 <> 0 THEN score END AS score)
        FROM scored""",
    ),
    "ranked": (
        ("hits",),
        """SELECT *, CAST(row_number() OVER (PARTITION BY question_id, tenant_key
        ORDER BY score DESC NULLS LAST, hit_rank) AS INTEGER) AS tenant_rank,
        max(score) OVER (PARTITION BY question_id, tenant_key) AS best_score,
        min(hit_rank) OVER (PARTITION BY question_id, tenant_key) AS tenant_first FROM hits""",
    ),
    "kept": (
        ("ranked",),
        """SELECT ranked.*, quota FROM ranked JOIN (SELECT question_id,
        CAST(greatest(1, 6 // count(DISTINCT tenant_key)) AS INTEGER) AS quota
        FROM hits GROUP BY question_id) USING (question_id) WHERE tenant_rank <= quota""",
    ),
    "entries": (
        ("kept",),
        f"""SELECT question_id, row_id, CAST(1 + row_number() OVER (PARTITION BY question_id
        ORDER BY tenant_first, tenant_rank) AS INTEGER) AS number,
        '[' || tenant_key || '] ' || CASE WHEN length(bare) > 800
        THEN substring(bare, 1, 800) || '…' ELSE bare END AS chunk
        FROM (SELECT *, trim(chunk_text, {_SPACES}) AS bare FROM kept)""",
    ),
    "contexts": (
        ("entries",),
        """SELECT question_id, string_agg('[' || number || '] ' || chunk,
        chr(10) || chr(10) ORDER BY number) AS context, count(*) AS n_chunks
        FROM entries GROUP BY question_id""",
    ),
    "prompts": (
        ("contexts", "questions"),
        f"""SELECT question_id, {_text(SYSTEM_TEXT)} || chr(10) || chr(10)
        || {_text(CONTEXT_HEADING)} || coalesce(context, '') || chr(10) || chr(10)
        || {_text(QUESTION_HEADING)} || question || chr(10) || chr(10) || {_text(CLOSING)}
        AS prompt, coalesce(n_chunks, 0) AS n_chunks
        FROM questions LEFT JOIN contexts USING (question_id)""",
    ),
}


def _sql(select: str, *parts: str) -> str:
    """The select after the subqueries that it needs, in order of need."""
    needed: dict[str, None] = {}

    def add(name: str) -> None:
        for before in _PARTS[name][0]:
            add(before)
        needed[name] = None

    for part in parts:
        add(part)
    if not needed:
        return select
    defined = ",\n".join(f"{name} AS ({_PARTS[name][1]})" for name in needed)
    return f"WITH {defined}\n{select}"


def _all(part: str, columns: str = "*") -> str:
    return _sql(f"SELECT {columns} FROM {part}", part)


# What the selection of the queries chooses in each facet.
_CHOSEN = {
    "tenant_name": "tenant_name IN ('AUTOMOBILE', 'BUILDING', 'HOUSEHOLD')",
    "year": "year IS NOT NULL",
    "month": "month IN (1, 2, 3, 12)",
    "region": "region IN ('ASIA', 'EUROPE', 'AFRICA')",
    "usage_type": "usage_type IS NOT NULL",
}


def _facet_counts() -> str:
    """Per facet value: is it chosen, rows chosen by the other facets, rows chosen by all."""
    parts = []
    for name, rule in _CHOSEN.items():
        others = " AND ".join(f"coalesce({r}, FALSE)" for n, r in _CHOSEN.items() if n != name)
        parts.append(
            f"""SELECT '{name}' AS facet, CAST({name} AS VARCHAR) AS value, {rule} AS is_chosen,
            count(*) FILTER ({others}) AS n_open, count(*) FILTER ({others} AND {rule}) AS n_rows
            FROM gold WHERE {name} IS NOT NULL GROUP BY {name}"""
        )
    return _sql(" UNION ALL ".join(parts), "gold")


# The published 32-bit hash of the words, modulo the number of entries, spelled out in arithmetic on unsigned numbers.
_MIX = "(({x} * 3432918353::UBIGINT) % 4294967296)"
_TURN = "((({x} << {n}) & 4294967295) | ({x} >> {back}))"


def _mixed(x: str) -> str:
    turned = _TURN.format(x=_MIX.format(x=x), n=15, back=17)
    return f"(({turned} * 461845907::UBIGINT) % 4294967296)"


_BYTE = "('0x' || substr(digits, {at} * 2 + 1, 2))::UBIGINT"
_FOUR = " | ".join(f"({_BYTE.format(at=f'(block * 4 + {i})')} << {8 * i})" for i in range(4))
_TAIL = " | ".join(
    f"(CASE WHEN size % 4 > {i} THEN {_BYTE.format(at=f'(size - size % 4 + {i})')} << {8 * i} ELSE 0::UBIGINT END)" for i in range(3)
)
_EMBEDDED_WORDS = rf"""WITH RECURSIVE listed AS (
    SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]+')) AS word FROM documents
), words AS (SELECT doc_id, word, count(*) AS n FROM listed GROUP BY ALL),
spelled AS (
    SELECT word, hex(encode(word)) AS digits, (length(hex(encode(word))) // 2)::BIGINT AS size
    FROM (SELECT DISTINCT word FROM words)
), steps(word, digits, size, block, h) AS (
    SELECT word, digits, size, 0::BIGINT, 42::UBIGINT FROM spelled
    UNION ALL
    SELECT word, digits, size, block + 1,
        ({_TURN.format(x="mixed", n=13, back=19)} * 5 + 3864292196::UBIGINT) % 4294967296
    FROM (SELECT *, xor(h, {_mixed("four")}) AS mixed FROM (SELECT *, {_FOUR} AS four FROM steps WHERE block < size // 4))
), ends AS (
    SELECT word, xor(CASE WHEN size % 4 > 0 THEN xor(h, {_mixed("tail")}) ELSE h END, size::UBIGINT) AS h
    FROM (SELECT *, {_TAIL} AS tail FROM steps WHERE block = size // 4)
), first AS (SELECT word, (xor(h, h >> 16) * 2246822507::UBIGINT) % 4294967296 AS h FROM ends),
second AS (SELECT word, (xor(h, h >> 13) * 3266489909::UBIGINT) % 4294967296 AS h FROM first),
hashed AS (SELECT word, (xor(h, h >> 16) % 256)::INTEGER AS entry FROM second)
SELECT doc_id, entry, sum(n)::BIGINT AS n_words FROM words JOIN hashed USING (word) GROUP BY doc_id, entry"""


def _violations(part: str, rules: dict[str, str], action: str | None) -> str:
    shown = f"'{action}' AS action, " if action else ""
    rows = [
        f"""SELECT '{name}' AS constraint, {shown}count(*) AS n_rows,
        count(*) FILTER (NOT coalesce({rule}, FALSE)) AS n_failed FROM {part}"""
        for name, rule in rules.items()
    ]
    return _sql(" UNION ALL ".join(rows).replace("AS constraint", 'AS "constraint"'), part)


# Names and predicates of the rules.
_RECORD_RULES = {
    "record_id_not_null": "record_id IS NOT NULL",
    "usage_quantity_non_negative": "usage_quantity >= 0",
    "valid_tenant_name": "tenant_name IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD')",
}
_DAILY_RULES = {
    "usage_unit_is_dbu": "usage_unit = 'DBU'",
    "usage_quantity_positive": "total_dbu > 0",
    "tenant_not_null": "tenant_name IS NOT NULL",
    "usage_date_not_null": "usage_date IS NOT NULL",
}
_COST_RULES = {"estimated_cost_non_negative": "est_cost_usd >= 0"}


def _report() -> str:
    """All rules of a refresh, each over the rows that reach its stage."""
    rows = [
        f"""SELECT '{name}' AS "constraint", '{stage}' AS stage, '{action}' AS action, count(*) AS n_rows,
        count(*) FILTER (NOT coalesce({rule}, FALSE)) AS n_failed FROM {part}"""
        for stage, part, action, rules in (
            ("bronze", "usage", "drop", _RECORD_RULES),
            ("silver", "daily", "drop", _DAILY_RULES),
            ("gold", "gold", "warn", _COST_RULES),
        )
        for name, rule in rules.items()
    ]
    return _sql(" UNION ALL ".join(rows), "usage", "daily", "gold")


_LATEST = """(SELECT est_cost_usd FROM rows_
ORDER BY year DESC, month DESC, tenant_name DESC, sku_name DESC, usage_type DESC,
usage_unit DESC, region DESC, node_type DESC LIMIT 1)"""


def _latest(part: str) -> str:
    return f"coalesce({_LATEST.replace('rows_', part)}, 0.0::DOUBLE)"


def _kpis(part: str, condition: str = "TRUE") -> str:
    rows = f"(SELECT * FROM {part} WHERE {condition})"
    return _sql(
        f"""SELECT coalesce(sum(est_cost_usd), 0.0::DOUBLE) AS total_cost,
        {_latest(rows + " AS r")} AS recent_cost,
        count(DISTINCT tenant_name) AS active_tenants FROM {rows}""",
        part,
    )


def _broken(rules: dict[str, str]) -> str:
    """Names of the rules that a row breaks, NULL if none."""
    listed = ", ".join(f"CASE WHEN NOT coalesce({rule}, FALSE) THEN '{name}' END" for name, rule in rules.items())
    return f"nullif(concat_ws(',', {listed}), '')"


def _history() -> str:
    report = _violations("usage", _RECORD_RULES, "drop")
    return f"""SELECT refresh_id, 'bronze' AS stage, r."constraint", r.action, r.n_rows, r.n_failed
        FROM (VALUES ('1'), ('2')) t(refresh_id) CROSS JOIN ({report}) r"""


_RATES = "as_of_ts, base_ccy, quote_ccy, fx_rate"

_EVERY_NEIGHBOUR = """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e
    FROM embeddings), s AS (SELECT a.vec_id AS question_id, b.vec_id AS chunk_id,
    round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a CROSS JOIN v b)
    SELECT *, CAST(row_number() OVER (PARTITION BY question_id
    ORDER BY score DESC, chunk_id) AS INTEGER) AS hit_rank FROM s QUALIFY hit_rank <= 5"""

ORACLE_SQL: dict[str, str] = {
    "scan_usage": _all("usage"),
    "scan_dataset": _all("price"),
    "pipeline_params": _sql(
        """SELECT tenant_name, count(*) AS n_records FROM usage WHERE record_id IS NOT NULL
        AND usage_quantity >= 0 AND tenant_name IN ('BUILDING', 'MACHINERY') GROUP BY 1""",
        "usage",
    ),
    "select_existing": _all("usage"),
    "expect_or_drop": _all("bronze"),
    "record_violations": _violations("usage", _RECORD_RULES, "drop"),
    "tenant_in_list": _sql(
        """SELECT tenant_name, tenant_name IN ('BUILDING', 'FURNITURE') AS listed,
        count(*) AS n_records FROM usage GROUP BY 1, 2""",
        "usage",
    ),
    "normalise_date": _all("usage", "record_id, CAST(usage_date AS DATE) AS usage_date"),
    "daily_usage": _all("silver"),
    "daily_usage_unchecked": _all("daily_all"),
    "silver_violations": _violations("daily_all", _DAILY_RULES, "drop"),
    "year_month": _all(
        "silver",
        """*, CAST(year(usage_date) AS INTEGER) AS year,
        CAST(month(usage_date) AS INTEGER) AS month""",
    ),
    "monthly_usage": _all("monthly"),
    "price_lookup": _all("priced"),
    "estimate_cost": _all("gold"),
    "gold_order": _all("gold") + " ORDER BY year, month, tenant_name, sku_name, node_type",
    "unpriced_usage": _sql(
        """SELECT * FROM monthly m WHERE NOT EXISTS (SELECT 1 FROM price p WHERE
        m.sku_name = p.sku_name AND m.region = p.region AND m.node_type = p.node_type)""",
        "monthly",
        "price",
    ),
    "expect": _violations("gold", _COST_RULES, None),
    "query_df": _sql(
        """SELECT region, year, sum(monthly_dbu) AS dbu, count(*) AS n_rows FROM gold
        GROUP BY region, year""",
        "gold",
    ),
    "load_billing_data": _all("gold"),
    "cast_period": _all("gold"),
    "preview": _all("gold")
    + " ORDER BY year, month, "
    + ", ".join(f"{key} NULLS LAST" for key in _KEYS.split(", "))
    + " LIMIT 5",
    "find_all_rows": "SELECT * FROM orders",
    "facet_filter": _all("chosen"),
    "facet_filter_selected": _all("selected"),
    "facet_values": _sql(
        " UNION ".join(
            f"SELECT '{name}' AS facet, CAST({name} AS VARCHAR) AS value FROM gold WHERE {name} IS NOT NULL"
            for name in ("tenant_name", "year", "month", "region", "usage_type")
        ),
        "gold",
    ),
    "daily_record_sets": _sql(
        f"""SELECT CAST(usage_date AS DATE) AS usage_date, {_KEYS}, count(DISTINCT record_id // 10) AS n_records
        FROM bronze GROUP BY ALL""",
        "bronze",
    ),
    "distinct_records": _sql(
        """SELECT tenant_name, region, count(DISTINCT record_id // 10) AS n_records FROM bronze GROUP BY ALL""", "bronze"
    ),
    "clustered_gold": _all("selected"),
    "facet_counts": _facet_counts(),
    "embedded_words": _EMBEDDED_WORDS,
    "total_cost": _all("selected", "coalesce(sum(est_cost_usd), 0.0::DOUBLE) AS total_cost"),
    "recent_cost": _sql(f"SELECT {_latest('selected')} AS recent_cost", "selected"),
    "last_row": _sql(
        """SELECT * FROM gold ORDER BY year DESC, month DESC, tenant_name DESC, sku_name DESC,
        usage_type DESC, usage_unit DESC, region DESC, node_type DESC LIMIT 1""",
        "gold",
    ),
    "last_period_cost": _sql(
        """SELECT sum(est_cost_usd) AS last_period_cost FROM chosen
        WHERE year * 100 + month = (SELECT max(year * 100 + month) FROM chosen)""",
        "chosen",
    ),
    "active_tenants": _all("selected", "count(DISTINCT tenant_name) AS active_tenants"),
    "cost_by_tenant": _sql(
        "SELECT tenant_name, sum(est_cost_usd) AS est_cost_usd FROM chosen GROUP BY 1", "chosen"
    ),
    "kpi_row": _kpis("chosen"),
    "kpi_row_empty": _kpis("chosen", "FALSE"),
    "top_tenants": _sql(
        """SELECT tenant_name, sum(est_cost_usd) AS est_cost_usd FROM selected GROUP BY 1
        ORDER BY 2 DESC, 1""",
        "selected",
    ),
    "detail_rows": _all("selected") + " ORDER BY year, month, tenant_name",
    "fx_pair_filter": _all("pair_ticks", _RATES),
    "fx_latest_cost": _sql(
        f"""SELECT gold.*, {_RATES}, est_cost_usd * fx_rate AS est_cost_krw FROM gold CROSS JOIN
        (SELECT {_RATES} FROM pair_ticks WHERE as_of_ts IS NOT NULL AND fx_rate IS NOT NULL
        ORDER BY as_of_ts DESC, fx_rate DESC LIMIT 1)""",
        "gold",
        "pair_ticks",
    ),
    "stream_changed_cost": _sql(
        f"""SELECT gold.*, {_RATES}, est_cost_usd * fx_rate AS est_cost_krw FROM gold CROSS JOIN
        (SELECT {_RATES} FROM pair_ticks WHERE as_of_ts IS NOT NULL AND fx_rate IS NOT NULL
        ORDER BY as_of_ts DESC, fx_rate DESC LIMIT 1)""",
        "gold",
        "pair_ticks",
    ),
    "fx_cross_join": _all("krw"),
    "fx_cross_join_grid": _all("krw"),
    "stream_fx_files": _all("ticks", _RATES),
    "stream_fx_lines": """SELECT CASE WHEN event_type NOT IN ('view', 'error') THEN 'USD' END AS base_ccy,
        CASE WHEN event_type <> 'error' THEN value END AS fx_rate,
        CASE event_type WHEN 'error' THEN 'no rate ' || event_id WHEN 'view' THEN
        CASE WHEN value IS NULL THEN '{"desk":' ELSE '{"fx_rate":' || value || ',"desk":' END
        || event_id || '}' END AS _rescued FROM events""",
    "grown_rates": """SELECT CASE WHEN event_type NOT IN ('view', 'error') THEN 'USD' END AS base_ccy,
        CASE WHEN event_type <> 'error' THEN value END AS fx_rate,
        CASE WHEN event_type = 'view' THEN CAST(event_id AS VARCHAR) END AS desk,
        CASE WHEN event_type = 'error' THEN 'no rate ' || event_id END AS _rescued FROM events""",
    "stream_dataset": _all("pair_ticks", _RATES),
    "append_stream": _all("krw"),
    "replace_stream": _all("ticks", _RATES),
    "stream_changed_rates": _sql(
        f"""SELECT {_RATES} FROM ticks WHERE as_of_ts IS NOT NULL AND fx_rate IS NOT NULL AND base_ccy IS NOT NULL
        AND quote_ccy IS NOT NULL QUALIFY row_number() OVER (PARTITION BY base_ccy, quote_ccy
        ORDER BY as_of_ts DESC, fx_rate DESC) = 1""",
        "ticks",
    ),
    "vector_top_k": _all("found"),
    "vector_top_k_grid": _EVERY_NEIGHBOUR,
    "vector_index": "SELECT vec_id AS chunk_id, TRUE AS inside FROM embeddings",
    "vector_top_k_indexed": _EVERY_NEIGHBOUR,
    "retrieve": _all("scored"),
    "rank_hits_in_tenant": _all("ranked", "question_id, row_id, tenant_key, score, tenant_rank"),
    "best_score": _all("ranked", "question_id, row_id, tenant_key, best_score"),
    "tenant_order": _all("ranked", "question_id, row_id, tenant_key, tenant_first"),
    "tenant_quota": _all("kept", "question_id, row_id, tenant_key, tenant_rank, quota"),
    "number_context": _all("entries"),
    "group_citations": _sql(
        """SELECT question_id, tenant_key AS tenant_name, min(tenant_first) AS tenant_first,
        max(score) AS best_score, CAST(count(*) AS INTEGER) AS n_chunks,
        string_agg(CAST(row_id AS VARCHAR), ',' ORDER BY tenant_rank) AS row_ids
        FROM ranked GROUP BY question_id, tenant_key""",
        "ranked",
    ),
    "flatten_citations": _all(
        "ranked",
        """question_id, best_score, tenant_first, tenant_rank, row_id, chunk_text, tenant_name,
        region, score""",
    ),
    "trim_truncate": _sql(
        f"""SELECT chunk_id, CASE WHEN length(bare) > 800 THEN substring(bare, 1, 800) || '…'
        ELSE bare END AS chunk
        FROM (SELECT chunk_id, trim(coalesce(text, ''), {_SPACES}) AS bare FROM chunks)""",
        "chunks",
    ),
    "tag_chunk": _all(
        "chunks",
        """chunk_id, '[' || coalesce(nullif(tenant_name, ''), '(unknown-tenant)') || '] '
        || coalesce(text, '') AS chunk""",
    ),
    "default_text": _all("chunks", "chunk_id, coalesce(text, '') AS chunk_text"),
    "tenant_key": _all(
        "chunks",
        """chunk_id, tenant_name,
        coalesce(nullif(tenant_name, ''), '(unknown-tenant)') AS tenant_key""",
    ),
    "safe_score": """SELECT event_id,
        CASE WHEN event_type NOT IN ('error', 'view') THEN value END AS score FROM events""",
    "split_trim_list": """SELECT p_partkey, CAST(unnest([0, 1, 2]) AS INTEGER) AS position,
        unnest([p_name, p_brand, p_type]) AS entry FROM part""",
    "join_context": _all("contexts"),
    "build_prompt": f"""SELECT item_id, {_text(SYSTEM_TEXT)} || chr(10) || chr(10)
        || {_text(CONTEXT_HEADING)} || '[' || item_id || '] ' || CASE WHEN length(bare) > 800
        THEN substring(bare, 1, 800) || '…' ELSE bare END || chr(10) || chr(10)
        || {_text(QUESTION_HEADING)} || text || chr(10) || chr(10) || {_text(CLOSING)} AS prompt
        FROM (SELECT *, trim(text, {_SPACES}) AS bare FROM benchmark)""",
    "answer_prompts": _all("prompts"),
    "decode_hit_rows": _all("hits", "* REPLACE (CAST(row_id AS VARCHAR) AS row_id)"),
    "decode_hit_dicts": _all("hits", "* EXCLUDE (row_id)"),
    "decode_hits": _sql(
        """SELECT * REPLACE (CAST(row_id AS VARCHAR) AS row_id) FROM hits
        UNION ALL SELECT * REPLACE (CAST(NULL AS VARCHAR) AS row_id) FROM hits""",
        "hits",
    ),
    "decode_embeddings": """SELECT vec_id // 8 AS request_id,
        CAST(vec_id % 8 AS INTEGER) AS position, CAST(dimension - 1 AS INTEGER) AS dimension,
        CAST(value AS DOUBLE) AS value FROM (SELECT vec_id, unnest(embedding) AS value,
        generate_subscripts(embedding, 1) AS dimension FROM embeddings)""",
    "undecoded_embeddings": """SELECT DISTINCT vec_id // 8 AS request_id,
        '{"points": ' || (vec_id // 8) || '}' AS body FROM embeddings WHERE (vec_id // 8) % 3 = 0""",
    "decode_completion": """SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text
        WHEN 1 THEN 'text|' || substring(text, 1, length(text) // 2) || '|image|not text|text|'
        || substring(text, length(text) // 2 + 1)
        ELSE 'tool|looked up|' || role || '|' || text END AS answer FROM conversations""",
    "unnormalised_messages": """SELECT conv_id, turn, '{"error": ' || turn || '}' AS body
        FROM conversations WHERE role = 'assistant'""",
    "normalise_message": """SELECT conv_id, turn,
        CAST(CASE WHEN turn % 3 = 2 THEN 1 ELSE 0 END AS INTEGER) AS position, role,
        text AS content FROM conversations
        UNION ALL SELECT conv_id, turn, 0, 'tool', 'looked up' FROM conversations
        WHERE turn % 3 = 2""",
    "last_message": "SELECT conv_id, turn, role, text AS content FROM conversations",
    "last_turn": """SELECT conv_id, arg_max(role, turn) AS role, arg_max(text, turn) AS text
        FROM conversations GROUP BY conv_id""",
    "embed_texts": r"""SELECT doc_id, 256 AS dimensions,
        CASE WHEN regexp_matches(text, '[\p{L}\p{N}_]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
        AS length FROM documents""",
    "generate": _sql(
        """SELECT question_id, '4,' || length(prompt) || '@0.2' AS answer FROM prompts""",
        "prompts",
    ),
    "materialize": _all("gold"),
    "refresh_report": _report(),
    "absorbed_gold": _all("gold"),
    "use_namespace": _all("price"),
    "reset_guard": _sql("SELECT TRUE AS refused, count(*) AS n_rows FROM price", "price"),
    "temp_view": _all("gold"),
    "load_fixture": """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name,
        CAST(c_nationkey AS VARCHAR) AS c_nationkey, CAST(c_acctbal AS VARCHAR) AS c_acctbal,
        c_mktsegment FROM customer""",
    "load_fixture_json": "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier",
    "quarantined": _sql(
        f"SELECT *, {_broken(_RECORD_RULES)} AS broken_rules FROM usage WHERE broken_rules IS NOT NULL", "usage"
    ),
    "kept_after_quarantine": _all("bronze"),
    "rule_history": _history(),
}
