"""Shared folders, written intermediate tables and other plumbing of the operators.

Intermediate tables cut lineage and survive lost executors: they are Parquet in the
folder that :mod:`treegate.shared` finds.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treegate.shared import shared_folder

#: Held while an intermediate table is written: its shuffle files go when it ends, Arrow batches are bounded in bytes,
#: and partitions are joined up to the advisory size, so small tables are few files.
_WHILE_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
}

#: Bits of a bitmap of keys, as a power of two, at most.
MOST_BITS = 27


#: Folders that go when this process ends, as nothing can read their tables then.
_passing: set[str] = set()


@atexit.register
def _sweep() -> None:
    for path in _passing:
        try:
            where, at = fs.FileSystem.from_uri(path)
            where.delete_dir(at)
        except (OSError, pa.ArrowException):  # never written, or gone already
            pass


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Removes the folders of all workspaces that are made within, once nothing made within is read any more."""
    before = set(_passing)
    yield
    for path in _passing - before:
        Workspace(spark, path=path).delete("")
        _passing.discard(path)


class Workspace:
    """A folder of its own in the shared folder, for the tables of one operator run."""

    def __init__(self, spark: SparkSession, name: str = "tables", path: str | None = None, keep: bool = False):
        """``path``: a folder that is there already. Others go when this process ends, unless ``keep``."""
        self.spark = spark
        self.path = path or f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        if path is None and not keep:
            _passing.add(self.path)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` and returns it as read from the files."""
        conf = self.spark.conf
        before = {k: conf.get(k, None) for k in _WHILE_WRITING}
        for k, v in _WHILE_WRITING.items():
            conf.set(k, v)
        try:
            df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)
        return self.read(name, df.schema)

    def read(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(f"{self.path}/{name}")

    def delete(self, name: str) -> None:
        """Removes a table that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def quoted(name: str) -> str:
    """A column's name as an expression takes it, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def unused(name: str, taken: list[str]) -> str:
    """``name``, or one like it that no column has."""
    while name.lower() in {x.lower() for x in taken}:
        name = f"_{name}"
    return name


def carried(docs: DataFrame, *into: str) -> tuple[list[str], DataFrame]:
    """The columns that stay beside new ones named ``into``, and ``docs`` as (row, text): all other columns in one struct."""
    names = [c for c in docs.columns if c.lower() not in {x.lower() for x in into}]
    rest = [F.col(quoted(c)).alias(c) for c in names if c != "text"]
    return names, docs.select(F.struct(*rest, F.lit(0).alias(unused("_", names))).alias("row"), "text")  # a struct needs a field


def unpacked(names: list[str], text: F.Column | None = None) -> list[F.Column]:
    """The columns of :func:`carried` again, from ``row`` and ``text``."""
    return [(F.col("text") if text is None else text).alias("text") if c == "text" else F.col(f"row.{quoted(c)}").alias(c) for c in names]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def marked(df: DataFrame, wanted: DataFrame, *key: str, bits: int | None = None) -> DataFrame:
    """``df`` with ``__maybe``: whether the row's key may be in ``wanted``; see :func:`likely`."""
    if bits is None:
        bits = min(MOST_BITS, max(16, (8 * wanted.count()).bit_length()))
    place = F.pmod(F.xxhash64(*key), F.lit(1 << bits))
    word, bit = F.shiftright(place, 6), place.bitwiseAND(F.lit(63)).cast("int")
    found = wanted.select(word.alias("__word"), F.call_function("shiftleft", F.expr("1L"), bit).alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    placed = df.withColumn("__word", word).withColumn("__at", bit).join(F.broadcast(found), "__word", "left")
    maybe = F.coalesce(F.call_function("shiftright", F.col("__bits"), F.col("__at")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return placed.select(*[F.col(quoted(c)) for c in df.columns], maybe.alias("__maybe"))


def likely(df: DataFrame, wanted: DataFrame, *key: str, bits: int | None = None) -> DataFrame:
    """The rows of ``df`` whose key may be in ``wanted``: all that are, and few others, without a shuffle of ``df``.

    A bitmap of 2**bits hashed keys, in rows of 64, is broadcast: 2**(bits - 6) pairs of
    numbers at most. There are eight bits or more for each row of ``wanted``, but never
    over 2**MOST_BITS, so what is broadcast stays under some 64 MB, and beyond some
    10**8 rows more and more others pass. A join that follows is exact; this only keeps
    texts that it would drop out of its shuffle.
    """
    return marked(df, wanted, *key, bits=bits).where("__maybe").drop("__maybe")


def without(df: DataFrame, gone: DataFrame, key: str, bits: int | None = None) -> DataFrame:
    """The rows of ``df`` whose ``key`` isn't in ``gone``; only those that the bitmap can't clear are shuffled."""
    split = marked(df, gone, key, bits=bits)
    clear, open_rows = split.where("not __maybe").drop("__maybe"), split.where("__maybe").drop("__maybe")
    return clear.unionByName(open_rows.join(gone.select(key), key, "left_anti").select([F.col(quoted(c)) for c in df.columns]))


def list_of(flat, counts, value_type: pa.DataType) -> pa.Array:
    """A list column from concatenated values and the length of each row's list."""
    import numpy as np

    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, value_type))
