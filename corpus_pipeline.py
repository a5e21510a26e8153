"""The corpus pipeline: stages over the documents table, each written and read again.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and all
but the last return the columns of documents, whatever further columns those have.  An
empty table gives an empty result at every stage; very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treegate.llm.common import Workspace, likely, passing, unused, without
from treegate.llm.decontaminate import find_items
from treegate.llm.langid import fit, identify
from treegate.llm.neardup import near_duplicates
from treegate.llm.packing import pack
from treegate.llm.suffix import remove_repeats

#: Least certainty of a language that a document is kept with.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language (null, or without a letter) or in none with any certainty.

    Rows are judged one by one: repeated rows and null ids stay or go with their text. A
    model that saw no labelled row knows no language, so everything goes.
    """
    names = [unused(n, docs.columns) for n in ("lang_pred", "score")]
    judged = identify(docs, fit(docs, F.lit(True)), tuple(names))
    return judged.where((F.col(names[0]) != "und") & (F.col(names[1]) >= LEAST_SCORE)).drop(*names)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates (five-word shingles, similarity 0.8): that of the smallest doc_id.

    Every row counts by itself, also if its doc_id repeats or is null; null ids come
    last. Texts without a word are in no group and stay.
    """
    work = Workspace(spark, "neardup-gone")
    key, group = (unused(n, docs.columns) for n in ("key", "group"))
    # written, so that a row has the same key whenever it is read
    keyed = work.write(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    found = near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"), k=5, percent=80)
    linked = work.write(found.where("not kept").select(F.col("doc_id").alias(key), F.col("component_id").alias(group)), "linked")
    members = linked.unionByName(linked.select(F.col(group).alias(key), group).distinct())
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(key).alias("key"))
    ids = likely(keyed.select("doc_id", key), members, key).join(members, key)
    first = ids.groupBy(group).agg(F.min(order).alias("o")).select(F.col("o.key").alias(key))
    gone = work.write(members.select(key).join(first, key, "left_anti"), "gone")
    return without(keyed, gone, key).drop(key)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out byte strings of 200 bytes or more that occur elsewhere; documents left without a word go.

    Null texts stay null. Every row is a document of its own, so equal rows would lose
    all that they share: the stage before leaves none. ``n_chars`` is counted again
    where a text was cut.
    """
    removed = unused("n_removed", docs.columns)
    cut = remove_repeats(docs, length=200, into=removed)
    emptied = (F.col(removed) > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    left = cut.where(~emptied | F.col("text").isNull())
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return left.drop(removed)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of ``benchmark``; an empty benchmark drops none, nor do null and empty texts go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = unused("items", docs.columns)
    return find_items(docs, benchmark, into=items).where(F.size(items) == 0).drop(items)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of what is left into sequences of at most 4096: one row per piece, with its token ids.

    Null and empty texts are their end id; rows that repeat a doc_id, or have none, are
    packed each.
    """
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("minhash_near_dedup", minhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express the learned stages; tests compare run() with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, writing each stage's rows as Parquet; the last table stays, all others go."""
    work = Workspace(spark, "pipeline", keep=True)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        with passing(spark):
            docs = work.write(stage(spark, docs, sf_dir), f"{i}_{name}")
        if i:
            work.delete(f"{i - 1}_{STAGES[i - 1][0]}")
    return docs
