"""Read JSON and CSV files by suffix."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession


def load_fixture(spark: SparkSession, path: str) -> DataFrame:
    """``.json`` holds a list of records; ``.csv`` has a header and gives text columns only.

    Meant for fixture files: a record may span lines, so a file is not split among tasks.
    """
    suffix = PurePosixPath(path).suffix.lower()
    if suffix == ".json":
        return spark.read.option("multiLine", True).json(path)
    if suffix == ".csv":
        reader = spark.read.options(header=True, multiLine=True, escape='"')
        return reader.csv(path).na.fill("")
    raise ValueError(f"unknown file type: {path}")
