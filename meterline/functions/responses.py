"""Decode JSON bodies of search, embedding and chat services.

Every body is parsed once to a variant, whose paths are then read without parsing again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.functions.text import default_text, safe_score, tenant_key

_BODY = "_body_variant"
_LIST = "array<variant>"


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once per row.

    Filters move below a plain column and compute its value again there; they do not move
    below a column that is unfolded, here from an array of just the value.
    """
    return df.withColumn(name, F.explode(F.array(value)))


def _parsed(bodies: DataFrame, body: str) -> DataFrame:
    return _once(bodies, _BODY, F.try_parse_json(F.col(body)))


def _at(value: Column | str, path: str, type_name: str = "variant") -> Column:
    return F.try_variant_get(value, path, type_name)


def _kept(bodies: DataFrame, body: str) -> list[Column]:
    return [F.col(name) for name in bodies.columns if name != body]


_HIT_FIELDS = ("row_id", "tenant_name", "region", "chunk_text", "score")


def _positional() -> Column:
    """Entries given as arrays; those of fewer than five values are left out."""
    rows = _at(_BODY, "$.result.data_array", _LIST)
    return F.filter(rows, lambda row: _at(row, "$[4]").isNotNull())


def _positional_fields(entry: Column) -> list[Column]:
    return [_at(entry, f"$[{place}]", "string") for place in range(len(_HIT_FIELDS))]


def _named() -> Column:
    return _at(_BODY, "$.result", _LIST)


def _named_fields(entry: Column) -> list[Column]:
    paths = ("metadata.tenant_name", "metadata.region", "metadata.text", "score")
    known = [_at(entry, f"$.{path}", "string") for path in paths]
    return [F.lit(None).cast("string"), *known]


def _hits(bodies: DataFrame, body: str, entries: Column, fields: list[Column]) -> DataFrame:
    """Unfold entries to hits; ``hit_rank`` is the arrival order within a body, from 1."""
    kept = _kept(bodies, body)
    unfolded = _parsed(bodies, body).select(*kept, F.posexplode(entries).alias("_pos", "_entry"))
    raw = unfolded.select(
        *kept,
        (F.col("_pos") + 1).alias("hit_rank"),
        *[column.alias(name) for name, column in zip(_HIT_FIELDS, fields)],
    )
    return raw.withColumns(
        {
            "chunk_text": default_text(F.col("chunk_text")),
            "score": safe_score(F.col("score")),
            "tenant_key": tenant_key(F.col("tenant_name")),
        }
    )


def decode_hit_rows(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Hits given as arrays ``[id, tenant, region, text, score]`` under ``result.data_array``.

    Arrays of fewer than five entries are skipped, further entries are ignored.
    """
    return _hits(bodies, body, _positional(), _positional_fields(F.col("_entry")))


def decode_hit_dicts(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Hits given as objects with ``metadata`` and ``score`` in a list under ``result``.

    An entry that is no object counts as a hit of which nothing is known. This shape has no
    row id.
    """
    return _hits(bodies, body, _named(), _named_fields(F.col("_entry")))


def decode_hits(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Hits of either shape, in one pass; the shape is told apart body by body."""
    tagged = F.transform(_positional(), lambda row: F.struct(F.lit(True).alias("p"), row.alias("v")))
    others = F.transform(_named(), lambda hit: F.struct(F.lit(False).alias("p"), hit.alias("v")))
    positional, value = F.col("_entry.p"), F.col("_entry.v")
    either = [
        F.when(positional, by_place).otherwise(by_name)
        for by_place, by_name in zip(_positional_fields(value), _named_fields(value))
    ]
    return _hits(bodies, body, F.coalesce(tagged, others), either)


def _vectors(bodies: DataFrame, body: str) -> DataFrame:
    matrix = "array<array<float>>"
    parsed = _parsed(bodies, body)
    data = _at(_BODY, "$.data", _LIST)
    from_data = F.transform(data, lambda row: _at(row, "$.embedding", "array<float>"))
    has = lambda path: _at(_BODY, path).isNotNull()
    vectors = (
        F.when(has("$.embeddings"), _at(_BODY, "$.embeddings", matrix))
        .when(has("$.data[0].embedding"), from_data)
        .when(has("$.vectors"), _at(_BODY, "$.vectors", matrix))
        .otherwise(_at(_BODY, "$", matrix))
    )
    return _once(parsed, "vectors", vectors).drop(_BODY)


def _is_decoded() -> Column:
    complete = ~F.exists("vectors", lambda vector: vector.isNull())
    return F.col("vectors").isNotNull() & complete


def decode_embeddings(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Vectors of a response as rows, ``position`` from 0.

    Known shapes: ``{embeddings: [..]}``, ``{data: [{embedding: ..}]}``, ``{vectors: [..]}``
    and a bare list. ``undecoded_embeddings`` gives the bodies of any other shape.
    """
    decoded = _vectors(bodies, body).filter(_is_decoded())
    return decoded.select(
        *_kept(bodies, body), F.posexplode("vectors").alias("position", "embedding")
    )


def undecoded_embeddings(bodies: DataFrame, body: str = "body") -> DataFrame:
    undecoded = _vectors(bodies, body).filter(~F.coalesce(_is_decoded(), F.lit(False)))
    return undecoded.drop("vectors")


def decode_completion(bodies: DataFrame, body: str = "body", output: str = "answer") -> DataFrame:
    """Text of the first choice, or the whole body where there is none."""
    content = _at(_BODY, "$.choices[0].message.content", "string")
    return _parsed(bodies, body).select(
        *_kept(bodies, body), F.coalesce(content, F.col(body)).alias(output)
    )


def _as_message(message: Column, content: Column) -> Column:
    return F.struct(_at(message, "$.role", "string").alias("role"), content.alias("content"))


def _normalised(bodies: DataFrame, body: str) -> DataFrame:
    given = F.transform(
        _at(_BODY, "$.messages", _LIST),
        lambda message: _as_message(message, _at(message, "$.content", "string")),
    )
    choice = _at(_BODY, "$.choices[0].message")
    content = _at(_BODY, "$.choices[0].message.content")
    kind = F.schema_of_variant(content)
    parts = F.filter(
        content.try_cast(_LIST), lambda part: _at(part, "$.type", "string") == "text"
    )
    joined = F.array_join(
        F.transform(parts, lambda part: default_text(_at(part, "$.text", "string"))), ""
    )
    from_choice = F.when(
        kind == "STRING", F.array(_as_message(choice, content.try_cast("string")))
    ).when(kind.startswith("ARRAY"), F.array(_as_message(choice, joined)))
    messages = F.when(_at(_BODY, "$.messages").isNotNull(), given).otherwise(from_choice)
    return _once(_parsed(bodies, body), "messages", messages).drop(_BODY)


def normalise_message(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Chat responses as ``messages``, an array of ``role, content``.

    A body has ``messages``, or a first choice whose content is text or a list of parts of
    which the text parts are joined. ``unnormalised_messages`` gives all other bodies.
    """
    return _normalised(bodies, body).filter("messages IS NOT NULL").drop(body)


def unnormalised_messages(bodies: DataFrame, body: str = "body") -> DataFrame:
    return _normalised(bodies, body).filter("messages IS NULL").drop("messages")


def last_message(normalised: DataFrame) -> DataFrame:
    """Last message of a response of several; NULL where there is none."""
    kept = [F.col(name) for name in normalised.columns if name != "messages"]
    last = F.try_element_at("messages", F.lit(-1))
    return normalised.select(
        *kept, last.getField("role").alias("role"), last.getField("content").alias("content")
    )
