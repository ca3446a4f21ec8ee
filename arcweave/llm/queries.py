"""The thin contract queries: op1 to op10 over their whole tables, and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .oracle import ORACLE_SQL  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    docs = table(spark, sf_dir, "documents")
    return identify(docs, declared=F.col("lang"), host_col=F.col("source")).withColumnRenamed("id", "doc_id")


def op2_pages_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import address_suffix, declared_language, host, identify, page_text

    pages = table(spark, sf_dir, "pages").withColumns({"declared": declared_language("html"), "text": page_text("html")})
    return identify(pages, id_col="page_id", declared=F.col("declared"), suffix=address_suffix("url"), host_col=host("url")).withColumnRenamed("id", "page_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import materialize
    from .secrets import BASE, find, spans_text, update

    docs = table(spark, sf_dir, "documents")
    # Two passes through a stored ledger: to the first every blob is new; the second finds no pair of blob and
    # rule version that the ledger lacks, scans nothing, and joins the ledger's findings back to all rows.
    ledger = materialize(update(docs, None))
    paths, _ = find(docs, ledger=ledger)
    base = tuple(r.kind for r in BASE)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return paths.select(F.col("path").alias("doc_id"), *map(count, base), F.sha2(spans_text("spans", base), 256).alias("base_sha256"), spans_text("spans").alias("spans"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract

    return extract(table(spark, sf_dir, "pages"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .setjoin import components

    return components(table(spark, sf_dir, "documents"))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import search

    return search(table(spark, sf_dir, "embeddings"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .passages import dedup

    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_token_counts, op2_language_id, op3_toxicity, op4_decontamination, op5_secret_scan, op6_html_extraction, op7_ngram_jaccard_join, op8_exact_topk, op9_substring_dedup, op10_best_fit_packing, pipeline)
} | {"pages_language_id": op2_pages_language_id}
