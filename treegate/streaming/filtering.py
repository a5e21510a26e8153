"""Stateless filtering of streams: a grammar's condition is per record, so no state or watermark is needed."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from treegate.operators.filtering import Grammar


def read_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", **options: Any) -> DataFrame:
    """A file stream with a fixed schema."""
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def filter_to_files(grammar: Grammar, stream: DataFrame, path: str, checkpoint: str, **how: Any) -> StreamingQuery:
    """Runs what is there through the grammar into Parquet files under ``path``, and ends.

    ``checkpoint`` (a folder that all executors see) holds what was read and written, so
    a query that is started again goes on where it ended and writes no row twice.
    """
    return grammar.filter(stream, **how).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
