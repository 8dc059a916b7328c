"""Exchange-rate files to converted costs, as append-only streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from meterline import settings as names
from meterline.operators.fx import cost_per_tick, fx_pair_filter
from meterline.settings import Settings
from meterline.sinks import temp_view

# Fields of a rate record.
FX_SCHEMA = T.StructType(
    [
        T.StructField("as_of_ts", T.TimestampType()),
        T.StructField("base_ccy", T.StringType()),
        T.StructField("quote_ccy", T.StringType()),
        T.StructField("fx_rate", T.DoubleType()),
    ]
)
CORRUPT = "_corrupt_record"
#: Text of a line whose content the fields of a rate do not hold in full.
RESCUED = "_rescued"
#: Files that one micro-batch takes in, unless told otherwise.
MAX_FILES = 100
RATE_DAY = "as_of_date"


def infer_schema(spark: SparkSession, path: str) -> T.StructType:
    """Column types as found in the files that are there now."""
    return spark.read.option("inferTimestamp", True).json(path).schema


def fx_file_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = FX_SCHEMA,
    max_files: int | None = None,
    keep_corrupt: bool = False,
    glob: str | None = None,
) -> DataFrame:
    """New JSON files of a folder as a stream; ``schema=None`` infers it from present files.

    A line that is no JSON gives NULL fields; ``keep_corrupt`` adds its text as a column.
    """
    fields = schema or infer_schema(spark, path)
    if keep_corrupt and CORRUPT not in fields.names:
        fields = T.StructType([*fields.fields, T.StructField(CORRUPT, T.StringType())])
    reader = spark.readStream.schema(fields)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    return reader.json(path)


def fx_line_stream(
    spark: SparkSession, path: str, max_files: int | None = MAX_FILES, glob: str | None = None, further: Sequence[str] = ()
) -> DataFrame:
    """New files of JSON lines as rates; what the four fields cannot hold stays as text.

    ``_rescued`` is the whole line if it is no JSON object, has further fields, or has a value
    that is not of its field's type, and NULL otherwise. Empty lines are skipped. Fields named
    in ``further`` are text columns; other values than text are given as their JSON.
    """
    reader = spark.readStream
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    return parsed_lines(reader.text(path).filter(F.trim("value") != ""), further)


def parsed_lines(lines: DataFrame, further: Sequence[str] = ()) -> DataFrame:
    """Lines (value) as rates with the further fields and ``_rescued``; works on batches and on streams."""
    fields = T.StructType([*FX_SCHEMA.fields, *(T.StructField(name, T.StringType()) for name in further)])
    rate = F.from_json("value", fields).alias("rate")
    keys = F.json_object_keys("value")
    unknown = F.size(F.array_except(keys, F.array(*map(F.lit, fields.names)))) > 0
    unread = F.lit(False)
    for name in FX_SCHEMA.names:
        unread = unread | (F.get_json_object("value", f"$.{name}").isNotNull() & F.col(f"rate.{name}").isNull())
    rescued = F.when(keys.isNull() | unknown | unread, F.col("value")).alias(RESCUED)
    return lines.select("value", rate).select("rate.*", rescued)


def stream_dataset(spark: SparkSession, name: str) -> DataFrame:
    """A stored streaming table or a streaming view, read as a stream."""
    return spark.readStream.table(name)


def append_stream(
    stream: DataFrame,
    checkpoint: str,
    table: str | None = None,
    path: str | None = None,
    available_now: bool = True,
    partition_by: Sequence[str] = (),
) -> StreamingQuery:
    """Append every micro-batch to a table or a folder, partitioned if asked for.

    The checkpoint and the log of the sink make a restart continue where it stopped,
    without losing or repeating rows.
    """
    if (table is None) == (path is None):
        raise ValueError("give either a table or a path")
    writer = stream.writeStream.outputMode("append").format("parquet")
    writer = writer.option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.toTable(table) if table is not None else writer.start(path)


def stream_converted_cost(costs: DataFrame, ticks: DataFrame) -> DataFrame:
    """Every new tick with every cost row; each tick appends a full copy of ``costs``.

    The costs are dealt evenly over the tasks and the ticks of a micro-batch, which
    ``max_files`` of the source bounds, are copied to them. New rows of the cost table are
    seen by the next micro-batch.
    """
    return cost_per_tick(costs, ticks)


def run_fx(
    spark: SparkSession,
    fx_path: str,
    checkpoint_root: str,
    settings: Settings | None = None,
    base: str = "USD",
    quote: str = "KRW",
    max_files: int = MAX_FILES,
) -> DataFrame:
    """Take in all new rate files and append the converted monthly costs.

    Rate files -> rate table -> view of one pair -> costs of the monthly table, all in the
    catalog and schema that are set. Lines that are no rates stay in the rate table as text.
    The costs are partitioned by day of the rate. Returns the stored costs. Call it again when
    new files have arrived.
    """
    settings = settings or Settings.load(spark)
    rate_table, cost_table = settings.qualified(names.FX_TABLE), settings.qualified(names.FX_COST_TABLE)
    append_stream(
        fx_line_stream(spark, fx_path, max_files), f"{checkpoint_root}/{names.FX_TABLE}", table=rate_table
    ).awaitTermination()
    rates = stream_dataset(spark, rate_table).select(*FX_SCHEMA.names)
    temp_view(fx_pair_filter(rates, base, quote), names.FX_PAIR_VIEW)
    temp_view(spark.read.table(settings.qualified(settings.gold_table)), names.GOLD_VIEW)
    converted = stream_converted_cost(
        spark.read.table(names.GOLD_VIEW), stream_dataset(spark, names.FX_PAIR_VIEW)
    )
    append_stream(
        converted.withColumn(RATE_DAY, F.to_date("as_of_ts")),
        f"{checkpoint_root}/{names.FX_COST_TABLE}",
        table=cost_table,
        partition_by=(RATE_DAY,),
    ).awaitTermination()
    return spark.read.table(cost_table)
