"""Exchange rates: choose a currency pair and convert costs at the latest or at every tick."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fx_pair_filter(ticks: DataFrame, base: str = "USD", quote: str = "KRW") -> DataFrame:
    """Ticks of one currency pair; works on batches and on streams."""
    return ticks.filter((F.col("base_ccy") == base) & (F.col("quote_ccy") == quote))


def convert_cost(df: DataFrame) -> DataFrame:
    return df.withColumn("est_cost_krw", F.col("est_cost_usd") * F.col("fx_rate"))


def latest_rate(ticks: DataFrame) -> DataFrame:
    """One row with the columns of the latest tick that has a rate; all NULL if there is none.

    Ties on time go to the higher rate. Tasks keep one tick each, so nothing is sorted.
    """
    rated = ticks.filter(F.col("fx_rate").isNotNull() & F.col("as_of_ts").isNotNull())
    tick = F.max_by(F.struct(*ticks.columns), F.struct("as_of_ts", "fx_rate"))
    return rated.agg(tick.alias("latest"))


def cost_at_latest(costs: DataFrame, ticks: DataFrame) -> DataFrame:
    """Every cost row once, with the latest tick and ``est_cost_krw``.

    The tick is one row, read as a scalar: the cost rows are neither joined nor shuffled.
    Without a rate the converted cost is NULL.
    """
    with_tick = costs.withColumn("latest", latest_rate(ticks).scalar())
    return convert_cost(with_tick.select("*", "latest.*").drop("latest"))


def cost_per_tick(
    costs: DataFrame, ticks: DataFrame, cost_slices: int | None = None, tick_slices: int = 1
) -> DataFrame:
    """Every cost row at every tick, with ``est_cost_krw``; ``ticks`` may be a stream.

    The result has |costs| x |ticks| rows by definition, so use it for few ticks or few
    costs, such as a bounded micro-batch against the monthly table; ``cost_at_latest`` is
    linear. The work is laid out as even cells that an equi-join matches: each side is dealt
    at random into its slices, equal rows included, and copied to those of the other side.
    By default the costs are dealt into as many slices as there are shuffle partitions and
    the ticks copied to them. The join is merged by name, because Spark's size check does
    not see the copies.

    To sum over cost rows, sum them first and convert the sums: the rate is a factor.
    """
    if cost_slices is None:
        cost_slices = int(costs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = _copied(_dealt(costs, "_row", cost_slices), "_column", tick_slices)
    right = _copied(_dealt(ticks, "_column", tick_slices), "_row", cost_slices)
    return convert_cost(left.hint("merge").join(right, ["_row", "_column"]).drop("_row", "_column"))


def _dealt(df: DataFrame, name: str, slices: int) -> DataFrame:
    number = F.floor(F.rand(1) * slices) if slices > 1 else F.lit(0)
    return df.withColumn(name, number.cast("int"))


def _copied(df: DataFrame, name: str, slices: int) -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
