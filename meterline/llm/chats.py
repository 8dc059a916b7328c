"""Chat formatting: conversations rendered by a compiled template, with the learned characters marked.

Control strings inside roles and texts are escaped so that they never stand in the output as
controls, and the escape can be undone: the formatted text is parsed back into the same turns.

Defined results: a null text or role is empty; turns are ordered by turn, then role, then text,
nulls first; repeated rows are turns of their own; rows without a conversation id are one
conversation; other columns are ignored. A conversation is rendered whole, since its text is one
value; conversations are spread over the tasks by id.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.llm.common import table
from meterline.llm.templates import compiled

# The control strings of the format.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|role|>")
#: The character that breaks control strings up, and what stands for itself.
BREAK = "␛"
TEMPLATE = """
{%- for turn in turns -%}
<s>{{ turn.role | escape }}<|role|>
{%- if turn.role == "user" -%} [INST]
{%- elif turn.role == "system" -%} <<SYS>>
{%- endif -%}
{%- if turn.role == "assistant" -%}
{% generation %}{{ turn.text | escape }}{% endgeneration %}
{%- else -%}{{ turn.text | escape }}
{%- endif -%}
{%- if turn.role == "user" -%} [/INST]
{%- elif turn.role == "system" -%} <</SYS>>
{%- endif -%} </s>
{%- endfor -%}
"""
_BREAKABLE = re.compile(f"{BREAK}|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS))
_BROKEN = re.compile(f"{BREAK}([01])")
_TURN = re.compile(
    r"<s>(?P<role>.*?)<\|role\|>(?:\[INST\](?P<user>.*?)\[/INST\]|<<SYS>>(?P<system>.*?)<</SYS>>|(?P<other>.*?))</s>",
    re.DOTALL,
)


def escape(text: str) -> str:
    return _BREAKABLE.sub(lambda m: f"{BREAK}0" if m[0] == BREAK else f"{m[0]}{BREAK}1", text)


def unescape(text: str) -> str:
    return _BROKEN.sub(lambda m: BREAK if m[1] == "0" else "", text)


def renderer(template: str = TEMPLATE) -> Callable[[list[dict[str, str]]], tuple[str, list[tuple[int, int]]]]:
    render = compiled(template, {"escape": escape})
    return lambda turns: render(turns=turns)


def parsed(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) pairs of a text that the default template made."""
    found = []
    for m in _TURN.finditer(formatted):
        text = next(part for part in m.group("user", "system", "other") if part is not None)
        found.append((unescape(m["role"]), unescape(text)))
    return found


FORMATTED = "formatted string, spans array<struct<start:bigint,end:bigint>>"


def _format(template: str):
    def run(turns: pa.Array) -> pa.Array:
        render = renderer(template)
        texts, spans = [], []
        for conversation in turns.to_pylist():
            rows = [{"role": t["role"] or "", "text": t["text"] or ""} for t in conversation]
            text, marked = render(rows)
            texts.append(text)
            spans.append([{"start": a, "end": b} for a, b in marked])
        pair = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        arrays = [pa.array(texts, pa.string()), pa.array(spans, pa.list_(pair))]
        return pa.StructArray.from_arrays(arrays, ["formatted", "spans"])

    return run


def format_chats(
    turns: DataFrame, template: str = TEMPLATE, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
    text: str = "text",
) -> DataFrame:
    """``conv_id``, the ``formatted`` text, and the ``spans`` (code points) that are learned."""
    renderer(template)  # a malformed template fails here, not in the tasks
    row = F.struct(F.col(f"`{turn}`").alias("turn"), F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("text"))
    chats = turns.groupBy(F.col(f"`{conv_id}`").alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("turns"))
    made = F.arrow_udf(_format(template), FORMATTED).asNondeterministic()
    return chats.select("conv_id", made("turns").alias("chat")).select("conv_id", "chat.*")


DIGEST = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def _digest(formatted: pa.Array, spans: pa.Array) -> pa.Array:
    rows = []
    for text, marked in zip(formatted.to_pylist(), spans.to_pylist(), strict=True):
        turns = parsed(text)
        whole = "".join(f"{role}\n{said}\n" for role, said in turns).encode()
        loss = "".join(unescape(text[s["start"] : s["end"]]) for s in marked)
        digests = hashlib.sha256(whole).hexdigest(), hashlib.sha256(loss.encode()).hexdigest()
        rows.append((len(turns), digests[0], len(loss), digests[1], len(text)))
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    columns = list(zip(*rows, strict=True)) or [()] * 5
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    return pa.StructArray.from_arrays(arrays, [part.split()[0] for part in DIGEST.split(", ")])


def digests(chats: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations: turns and learned text, as digests."""
    read = F.arrow_udf(_digest, DIGEST).asNondeterministic()
    return chats.select("conv_id", read("formatted", "spans").alias("read")).select("conv_id", "read.*")


def op2_chat_formatting(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]").alias("text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role, said)
    return digests(format_chats(turns.union(more)))


OP2_SQL = """
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), chats AS (
    SELECT conv_id, count(*)::BIGINT AS n_turns,
           string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
           coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
           sum(length(replace(replace(replace(replace(replace(replace(replace(replace(role || chr(0) || text,
               '␛', '␛0'), '<s>', '....x'), '</s>', '....xx'), '[INST]', '....xxxx'), '[/INST]', '....xxxxx'),
               '<<SYS>>', '....xxxxx'), '<</SYS>>', '....xxxxxx'), '<|role|>', '....xxxxxx')) - 1
               + 15 + CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 15 ELSE 0 END)::BIGINT AS formatted_chars
    FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
       sha256(loss) AS loss_sha256, formatted_chars
FROM chats
"""
