"""Fields that rate files grow: a stored list of them, read as columns from the next start on.

Lines with fields that no column holds are kept whole as text. When a field recurs in such lines it is
added to the stored list; the next start of the stream reads it as a text column, and lines that
were stored before are filled in when they are read. Nothing that is stored is rewritten.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from meterline.streaming.fx import FX_SCHEMA, MAX_FILES, RESCUED, fx_line_stream, parsed_lines
from meterline.streaming.rates import replace_stream

#: Lines in which a field must occur, and fields that are added at one time; others stay in the text.
MIN_LINES = 2
MAX_FIELDS = 64
_LIST = "position int, field string, n_lines bigint"


def known_fields(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The further fields listed so far, in the order in which they came."""
    return tuple(r.field for r in _listed(spark, path).orderBy("position", "field").collect())


def _listed(spark: SparkSession, path: str) -> DataFrame:
    try:
        listed = spark.read.schema(_LIST).parquet(f"{path.rstrip('/')}/fields")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        listed = spark.createDataFrame([], _LIST)  # nothing is listed yet
    return listed.groupBy("field").agg(F.min("position").alias("position"))


def grow_fields(rates: DataFrame, path: str, min_lines: int = MIN_LINES, max_fields: int = MAX_FIELDS) -> tuple[str, ...]:
    """Add fields that recur in rescued lines to the list below the path; returns the whole list.

    Lines are counted by field in the tasks; the most frequent ``max_fields`` are added, ties by name.
    Fields whose names differ only in case from a known one stay in the text, since columns do not.
    """
    spark = rates.sparkSession
    known = known_fields(spark, path)
    held = F.array(*[F.lit(name.lower()) for name in (*FX_SCHEMA.names, RESCUED, *known)])
    keys = rates.filter(F.col(RESCUED).isNotNull()).select(F.explode(F.array_distinct(F.json_object_keys(RESCUED))).alias("field"))
    counted = keys.groupBy("field").agg(F.count(F.lit(1)).alias("n_lines")).filter(F.col("n_lines") >= min_lines)
    new = counted.filter((F.trim("field") != "") & ~F.array_contains(held, F.lower("field")))
    # Of fields that differ in case the most frequent one is taken.
    one = new.groupBy(F.lower("field").alias("lower")).agg(F.max_by(F.struct("field", "n_lines"), F.struct("n_lines", "field")).alias("best"))
    taken = one.select("best.*").orderBy(F.desc("n_lines"), "field").limit(max_fields).collect()
    if taken:
        rows = [(len(known) + i, r.field, r.n_lines) for i, r in enumerate(taken)]
        spark.createDataFrame(rows, _LIST).coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/fields")
    return known_fields(spark, path)


def stored_rates(spark: SparkSession, path: str) -> DataFrame:
    """All stored rates with every listed field; lines stored before a field was listed are filled in from their text."""
    further = known_fields(spark, path)
    text = [T.StructField(name, T.StringType()) for name in (*further, RESCUED)]
    schema = T.StructType([*FX_SCHEMA.fields, *text])
    columns = [f"`{name}`" for name in schema.names]
    rows = spark.read.schema(schema).parquet(f"{path.rstrip('/')}/rates").select(*columns)
    again = parsed_lines(rows.filter(F.col(RESCUED).isNotNull()).select(F.col(RESCUED).alias("value")), further)
    return rows.filter(F.col(RESCUED).isNull()).union(again.select(*columns))


def take_in(spark: SparkSession, source: str, path: str, checkpoint: str, max_files: int = MAX_FILES) -> StreamingQuery:
    """Store new rate files below the path, each listed field in a column of its own.

    Micro-batches replace their own partition, so each may have columns that earlier ones lack. Call
    ``grow_fields`` on ``stored_rates`` between runs.
    """
    stream = fx_line_stream(spark, source, max_files, further=known_fields(spark, path))
    return replace_stream(stream, checkpoint, path=f"{path.rstrip('/')}/rates")
