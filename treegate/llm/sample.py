"""Bounded samples of labelled rows for the classifiers: the only rows that reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fold(doc_id: str, parts: int) -> F.Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(parts)).cast("int")


def bounded_sample(df: DataFrame, label: str, per_class: int, *key: str) -> DataFrame:
    """At most ``per_class`` rows of each value of ``label``, the same ones at every run and partitioning.

    Those with the smallest hash of ``key``: a share of the hash space that holds about
    twice the number asked for is cut first, so only a bounded number of rows is sorted.
    """
    counts = df.groupBy(label).agg(F.count("*").alias("__n"))
    order = F.xxhash64(*[F.col(c) for c in key], F.lit(29))
    share = F.lit(2.0 * per_class + 50) / F.col("__n")
    near = df.join(F.broadcast(counts), label).where(F.pmod(order, F.lit(1_000_000)) < share * 1_000_000)  # a row a class
    rank = F.row_number().over(Window.partitionBy(label).orderBy(order, *key))
    return near.withColumn("__rank", rank).where(F.col("__rank") <= per_class).drop("__rank", "__n")
