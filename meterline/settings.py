"""Run-time parameters, read from the Spark session and the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

# Default dataset names, parameter names and defaults.
SOURCE_TABLE_KEY = "p_source_table"
TENANT_LIST_KEY = "p_tenant_list"
DEFAULT_SOURCE_TABLE = "mock_billing_usage_clean"
DEFAULT_TENANT_LIST = "천재교육,천재교과서,해법에듀,밀크티"
BRONZE_TABLE = "billing_bronze_usage"
SILVER_TABLE = "billing_silver_tenant_daily"
GOLD_TABLE = "billing_gold_tenant_monthly"
PRICE_TABLE = "dim_dbu_price"
FX_TABLE = "fx_rates_bronze"
FX_PAIR_VIEW = "v_fx_usd_krw"
GOLD_VIEW = "v_billing_monthly_usd"
FX_COST_TABLE = "billing_gold_tenant_monthly_fx_streaming"
DEFAULT_HIT_COLUMNS = "chunk_id,tenant_name,region,text"
DEFAULT_TOP_K = 5


def split_names(text: str) -> tuple[str, ...]:
    """Entries of a comma list, trimmed, without the empty ones."""
    return tuple(name for name in map(str.strip, text.split(",")) if name)


@dataclass(frozen=True)
class Settings:
    source_table: str = DEFAULT_SOURCE_TABLE
    tenants: tuple[str, ...] = split_names(DEFAULT_TENANT_LIST)
    price_table: str = PRICE_TABLE
    catalog: str | None = None
    schema: str | None = None
    gold_table: str = GOLD_TABLE
    hit_columns: tuple[str, ...] = split_names(DEFAULT_HIT_COLUMNS)
    top_k: int = DEFAULT_TOP_K

    @classmethod
    def load(
        cls, spark: SparkSession, env: Mapping[str, str] | None = None, **overrides
    ) -> "Settings":
        """Defaults, then environment, then session conf, then explicit overrides."""
        env = os.environ if env is None else env
        known = {f.name for f in fields(cls)}
        if unknown := overrides.keys() - known:
            raise TypeError(f"unknown settings: {sorted(unknown)}")
        found = {
            "source_table": spark.conf.get(SOURCE_TABLE_KEY, DEFAULT_SOURCE_TABLE),
            "tenants": split_names(spark.conf.get(TENANT_LIST_KEY, DEFAULT_TENANT_LIST)),
            "catalog": env.get("UC_CATALOG"),
            "schema": env.get("UC_SCHEMA"),
            "gold_table": env.get("GOLD_TABLE", GOLD_TABLE),
            "hit_columns": split_names(env.get("VS_COLUMNS", DEFAULT_HIT_COLUMNS)),
            "top_k": int(env.get("TOP_K", DEFAULT_TOP_K)),
        }
        return cls(**{**found, **overrides})

    def qualified(self, table: str) -> str:
        """Table name with the catalog and schema that are set; a name that has its own keeps it."""
        if "." in table:
            return table
        parts = [self.catalog, self.schema, table]
        return ".".join(f"`{part}`" for part in parts if part)
