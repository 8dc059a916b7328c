"""Changed exchange rates from a stream of ticks, and costs converted once for each change.

A stream against a cost table gives a copy of the costs for every tick. Here the state of the
stream keeps the newest tick of each currency pair, and only a newer tick with another rate goes
on; so the stored costs grow with the changes of the rate and not with the ticks. Costs are
written by batch, in a partition that is replaced, so a batch that runs again leaves one copy.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from meterline import settings as names
from meterline.operators.fx import cost_per_tick, fx_pair_filter
from meterline.settings import Settings
from meterline.streaming.fx import FX_SCHEMA, MAX_FILES, append_stream, fx_line_stream, stream_dataset

# The task functions below travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PAIR = ("base_ccy", "quote_ccy")
_ORDER = ("as_of_ts", "fx_rate")
#: State of a pair: its newest tick, in microseconds since 1970.
_STATE = T.StructType([T.StructField("micros", T.LongType()), T.StructField("fx_rate", T.DoubleType())])
#: The partition of a batch in a table or folder that ``replace_stream`` writes.
BATCH = "batch_id"


def _newest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The newest tick of each pair in a batch of rows, so that few rows of a frequent pair are shuffled."""
    for batch in batches:
        order = [(name, "ascending") for name in PAIR] + [(name, "descending") for name in _ORDER]
        rows = pa.Table.from_batches([batch]).sort_by(order)
        if rows.num_rows > 1:
            same = pc.and_(*[pc.equal(rows[n].slice(1), rows[n].slice(0, len(rows) - 1)) for n in PAIR])
            first = pa.concat_arrays([pa.array([True]), pc.invert(same.combine_chunks())])
            rows = rows.filter(first)
        yield from rows.to_batches()


def _changes(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The newest tick of a micro-batch, if it is newer than the one held and has another rate."""
    held = state.get if state.exists else None
    best = held
    for part in parts:
        micros = part["micros"].max()
        found = (int(micros), float(part.loc[part["micros"] == micros, "fx_rate"].max()))
        # Ties on time go to the higher rate, as in a batch.
        if best is None or found > tuple(best):
            best = found
    if best is None or best == held:
        return
    state.update(tuple(best))
    if held is None or best[1] != held[1]:
        yield pd.DataFrame({PAIR[0]: [key[0]], PAIR[1]: [key[1]], "micros": [best[0]], "fx_rate": [best[1]]})


def changed_rates(ticks: DataFrame) -> DataFrame:
    """A stream of ticks as a stream of changes: at most one row for each pair and micro-batch.

    A pair's newest tick is kept as state. A tick that is older than it, or the same, is ignored; a
    newer one with the same rate only moves the time; a newer one with another rate is given out.
    Of the ticks of one micro-batch the newest counts. Ticks without time, pair or rate take no part.
    State is one row for each pair, so it needs no time-out.
    """
    wanted = [name for name in FX_SCHEMA.names]
    known = ticks.select(*wanted).dropna(subset=wanted).filter(~F.isnan("fx_rate"))
    newest = known.mapInArrow(_newest, known.schema)
    timed = newest.select(*PAIR, F.unix_micros(F.col("as_of_ts").cast("timestamp")).alias("micros"), "fx_rate")
    out = T.StructType([timed.schema[PAIR[0]], timed.schema[PAIR[1]], *_STATE.fields])
    changes = timed.groupBy(*PAIR).applyInPandasWithState(_changes, out, _STATE, "append", GroupStateTimeout.NoTimeout)
    return changes.select(F.timestamp_micros("micros").alias("as_of_ts"), *PAIR, "fx_rate")


def replace_stream(
    stream: DataFrame,
    checkpoint: str,
    path: str | None = None,
    table: str | None = None,
    then=None,
    available_now: bool = True,
) -> StreamingQuery:
    """Write every micro-batch to a partition ``batch_id`` of its own, which is replaced if it is there.

    A batch that was written but not committed runs again after a restart, with the same rows and
    number; it then takes the place of what it wrote, so there is one copy, also if it has no rows the
    second time. ``then`` maps a batch of the stream to the rows to write, such as a join with a table as
    it is at that time. A table must exist, partitioned by ``batch_id``, its last column.
    """
    if (table is None) == (path is None):
        raise ValueError("give either a table or a path")

    def write(batch: DataFrame, number: int) -> None:
        rows = batch if then is None else then(batch)
        if path is not None:
            rows.write.mode("overwrite").parquet(f"{path}/{BATCH}={number}")
            return
        spark = rows.sparkSession
        columns = [c for c in spark.read.table(table).columns if c != BATCH]
        view = f"replaced_{number}"
        rows.select(*[f"`{c}`" for c in columns]).createOrReplaceTempView(view)
        try:
            spark.sql(f"INSERT OVERWRITE TABLE {table} PARTITION ({BATCH} = {number}) SELECT * FROM {view}")
        finally:
            spark.catalog.dropTempView(view)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def convert_on_change(
    costs, ticks: DataFrame, checkpoint: str, path: str | None = None, table: str | None = None, available_now: bool = True
) -> StreamingQuery:
    """For each change of a rate one converted copy of the costs, as they are at that time.

    ``costs`` is a function that reads them. A micro-batch has one rate a pair at most, so its output is
    linear in the costs. They are dealt over the tasks and the rates copied to them.
    """
    return replace_stream(
        changed_rates(ticks), checkpoint, path, table, then=lambda rates: cost_per_tick(costs(), rates), available_now=available_now
    )


def run_fx_changes(
    spark: SparkSession,
    fx_path: str,
    checkpoint_root: str,
    settings: Settings | None = None,
    base: str = "USD",
    quote: str = "KRW",
    max_files: int = MAX_FILES,
) -> DataFrame:
    """Take in all new rate files and store the monthly costs anew where the rate has changed.

    As ``fx.run_fx``, with a copy of the monthly table for each change and not for each tick. Returns
    the stored costs; those of the highest ``batch_id`` are at the newest rate.
    """
    settings = settings or Settings.load(spark)
    rate_table = settings.qualified(names.FX_TABLE)
    cost_table = settings.qualified(f"{names.FX_COST_TABLE}_changes")
    arriving = fx_line_stream(spark, fx_path, max_files)
    append_stream(arriving, f"{checkpoint_root}/{names.FX_TABLE}", table=rate_table).awaitTermination()
    ticks = fx_pair_filter(stream_dataset(spark, rate_table).select(*FX_SCHEMA.names), base, quote)
    gold = lambda: spark.read.table(settings.qualified(settings.gold_table))
    if not spark.catalog.tableExists(cost_table):
        none = spark.createDataFrame([], FX_SCHEMA)
        empty = cost_per_tick(gold().limit(0), none).withColumn(BATCH, F.lit(0).cast("long"))
        empty.write.partitionBy(BATCH).saveAsTable(cost_table)
    convert_on_change(gold, ticks, f"{checkpoint_root}/{names.FX_COST_TABLE}_changes", table=cost_table).awaitTermination()
    return spark.read.table(cost_table)
