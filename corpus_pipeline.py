"""From raw documents to token files: five stages, each an operator of ``kestrel.llm``.

Every stage reads what the one before it wrote.  All but the last return
documents in their own columns: rejected ones are gone (quality), one document
of each near-duplicate group is left (near_duplicates), documents that hold
benchmark windows are gone (decontamination), and documents are there as often
as the mix takes them (mixing).  The last writes the token files and returns
what it reads back from them, a row per document of the mix.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kestrel.llm import decontaminate, mixing, quality, simhash, tokenfile
from kestrel.session import materialize, scratch_path, ship_package

VOCABULARY = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return simhash.representatives(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(docs, _table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return mixing.resample(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    path = scratch_path(spark, "token-files")
    tokenfile.write(docs, path, public_tokenizers.path(VOCABULARY))
    return tokenfile.read_documents(spark, path)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_files", token_stage),
]

#: The quality model, SimHash components and the tokenizer can't be put in SQL; tests hold each stage against a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; returns the rows of the last: doc_id, start, n_tokens, ids_crc32."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
