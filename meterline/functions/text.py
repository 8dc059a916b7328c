"""Column functions on text: names, scores, context chunks and prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stand-in for a missing tenant, chunk length and the mark of a cut chunk.
UNKNOWN_TENANT = "(unknown-tenant)"
CHUNK_CHARS = 800
CUT_MARK = "…"

# The wording of the prompt.
SYSTEM_TEXT = (
    "You are a tenant-billing analyst.\n"
    "Explain monthly usage and cost per tenant in clear English, "
    "and focus on business insights (spikes, anomalies, top SKUs, regions).\n"
)
CONTEXT_HEADING = "# Context (tenant monthly usage rows)\n"
QUESTION_HEADING = "# User question\n"
CLOSING = "# Answer in business terms, focusing on tenant-level usage & cost insights.\n"

WHITESPACE = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())


def split_trim_list(names: Column) -> Column:
    """Comma list to an array of its trimmed, non-empty entries."""
    trimmed = F.transform(F.split(names, ","), strip)
    return F.filter(trimmed, lambda name: name != "")


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends (plain ``trim`` removes blanks only)."""
    return F.btrim(text, F.lit(WHITESPACE))


def tenant_key(tenant: Column) -> Column:
    return F.coalesce(F.nullif(tenant, F.lit("")), F.lit(UNKNOWN_TENANT))


def default_text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def safe_score(score: Column) -> Column:
    """Score as a double, NULL where it is not a number (also ``1.5d``, which a cast takes)."""
    text = score.cast("string")
    java_suffix = text.rlike(r"[0-9.][dDfF]\s*$")
    return F.when(~java_suffix, text.try_cast("double"))


def trim_truncate(text: Column, limit: int = CHUNK_CHARS) -> Column:
    """Stripped text; a longer one is cut to ``limit`` characters and marked."""
    bare = strip(default_text(text))
    cut = F.concat(F.substring(bare, 1, limit), F.lit(CUT_MARK))
    return F.when(F.length(bare) > limit, cut).otherwise(bare)


def tag_chunk(tenant: Column, text: Column) -> Column:
    return F.concat(F.lit("["), tenant, F.lit("] "), text)


def number_chunk(number: Column, chunk: Column) -> Column:
    return F.concat(F.lit("["), number.cast("string"), F.lit("] "), chunk)


def build_prompt(context: Column, question: Column, system_text: str = SYSTEM_TEXT) -> Column:
    return F.concat(
        F.lit(f"{system_text}\n\n{CONTEXT_HEADING}"),
        context,
        F.lit(f"\n\n{QUESTION_HEADING}"),
        question,
        F.lit(f"\n\n{CLOSING}"),
    )
