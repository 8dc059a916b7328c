"""Time the headline queries; prints one JSON line.

Each query runs once untimed on the smallest test tables, which starts the workers and
compiles the plans, and then once timed on the tables asked for.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from meterline.plans import medallion  # noqa: E402
from meterline.registry import inputs  # noqa: E402
from meterline.registry.queries import QUERIES  # noqa: E402
from meterline.session import local_session, stored  # noqa: E402

HEADLINE = (
    "daily_usage",
    "estimate_cost",
    "expect",
    "facet_values",
    "kpi_row",
    "top_tenants",
    "fx_latest_cost",
    "fx_cross_join",
    "append_stream",
    "vector_top_k",
    "vector_top_k_grid",
    "group_citations",
    "answer_prompts",
    "trim_truncate",
    "decode_hit_rows",
    "decode_embeddings",
    "normalise_message",
    "embed_texts",
    "refresh_report",
)


def run(spark, name: str, sf_dir: str) -> float:
    """Seconds for the whole query: every row and column is computed, nothing is fetched."""
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def stored_usage(spark, sf_dir: str) -> float:
    """Seconds from stored usage records to the monthly table, without deriving the records."""
    usage = stored(inputs.usage(spark, sf_dir), "bench-usage")
    start = time.perf_counter()
    monthly = medallion.monthly_billing(usage, inputs.price(spark, sf_dir), inputs.TENANTS)
    monthly.write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    small = Path(sf_dir).with_name("sf0.001")
    if small.is_dir():
        for name in HEADLINE:
            run(spark, name, str(small))
    seconds = {name: run(spark, name, sf_dir) for name in HEADLINE}
    seconds["stored_usage_to_gold"] = stored_usage(spark, sf_dir)
    scale = Path(sf_dir).name.removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
