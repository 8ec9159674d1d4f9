"""From raw documents to packed training sequences, in five stages over the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.llm import decontaminate, packing, prefix_free, quality_rules, simhash
from basketlens.llm.queries import tokenizer_path
from basketlens.llm.runtime import ready
from basketlens.operators.release import Files
from basketlens.session import shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; null, empty and short texts do not. Repeated rows pass each; an empty table stays empty."""
    return quality_rules.keep(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more. Null and empty texts are one group, repeated rows one document; a very long text is one set of shingles."""
    return simhash.keep_one(docs, width=5, least=0.8)


def repeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 200 bytes that also start elsewhere; n_chars follows. Documents that this leaves without words go, those that had none stay; nulls stay null."""
    left = prefix_free.clean(docs, length=200)
    return left.withColumn("n_chars", F.when(F.col("n_chars").isNull(), None).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))


def test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items; null and empty texts hold none, and no items leave all. Repeated rows go or stay together."""
    return decontaminate.drop(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, with their places in sequences of 2048 tokens; a null or empty text is one end id."""
    return packing.pack(docs, tokenizer_path(), 2048, 0)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", rules),
    ("simhash_near_dedup", near_copies),
    ("suffix_array_dedup", repeated_text),
    ("benchmark_decontamination", test_items),
    ("best_fit_packing", packed),
]

#: Fingerprint groups, alignment and tokenizer have no form in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the tables in between go to the shared folder, and each goes when the next is written."""
    ready(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    files = Files(spark, folder)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}_{name}")
            docs = spark.read.parquet(f"{folder}/{k}_{name}")
            if before:
                files.remove(before)
            before = f"{folder}/{k}_{name}"
    return docs
