"""The thin queries over the driver's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from treegate.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


@query
def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from treegate.llm.tokenids import token_ids

    return token_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


@query
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from treegate.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


@query
def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from treegate.llm.suffix import repeat_report

    return repeat_report(table(spark, sf_dir, "documents"), length=200)


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from treegate.llm.warc import archive_round_trip

    return archive_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op6_warc"] = """
with p as (select page_id, encode(coalesce(html, '')) b from pages),
d as (select page_id, octet_length(b) n, sha256(b) h from p),
f as (select *, min(page_id) over (partition by h) first from d)
select page_id, n::bigint payload_bytes, h payload_digest,
       case when n >= 100 and page_id > first then 'revisit' else 'response' end record_type,
       case when n >= 100 and page_id > first then first end refers_to
from f
"""


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from treegate.llm.langid import fit, identify
    from treegate.llm.sample import fold

    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    model = fit(docs, fold("doc_id", 4) != 2)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from treegate.llm.quality import fit, score
    from treegate.llm.sample import fold

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    scored = score(docs, fit(docs, labels, fold("doc_id", 5) != 0))
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from treegate.llm.rules import fit, judge

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    judged = judge(docs, fit(docs, labels, F.lit(True)))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from treegate.llm.decontaminate import find_items

    found = find_items(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("items").alias("hit")).select("doc_id", "hit.*")


@query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from treegate.llm.licenses import license_scan

    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 1000).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return license_scan(docs.select("doc_id", path.alias("path"), "text"))


def _license_oracle() -> str:
    from treegate.llm.licenses import oracle

    return oracle()


ORACLES["op2_license_scan"] = _license_oracle()
