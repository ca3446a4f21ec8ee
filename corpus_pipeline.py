"""A training corpus in five stages, each one of the operators in ``arcweave.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
reread as the next one's ``docs``. All but the last return the columns of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.llm import decontam, langid, packing, secrets, setjoin
from arcweave.llm.common import materialize, release

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with confidence; ``lang`` becomes what was told."""
    return langid.keep_identified(docs, declared="lang", host="source").select(*COLUMNS)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of five-word shingle Jaccard 0.8 or more."""
    return setjoin.keep_one(docs, k=5, percent=80).select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return decontam.drop_leaked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts masked and n_chars brought up to date."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, and their places in sequences of 4096 tokens."""
    # Workers come from other stages: they keep less here than where packing runs alone.
    return packing.pack(docs, keep_words=350_000, batch_chars=4 << 20)


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scan),
    ("best-fit packing", best_fit_packing),
]

#: Tokenization and the statistical language model are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
        if before is not None:
            release(before)
        before = docs
    out = STAGES[-1][1](spark, docs, sf_dir)  # reads only the pieces that it has written
    release(docs)
    return out
