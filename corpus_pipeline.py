"""From raw documents to packed training sequences, in five stages.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows that the stage before it kept, and
returns the columns of ``documents``; the last returns the pieces of the packed sequences. Between two
stages the rows are written as Parquet and read again. Empty tables pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from webloom.llm import exact_dedup, packing, quality, simhash, toxicity
from webloom.session import materialize, prepare


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/labels.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps."""
    prepare(spark)
    return quality.keep_good(docs, _labels(spark, sf_dir))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half."""
    prepare(spark)
    return toxicity.drop_toxic(docs, toxicity.fit(docs, _labels(spark, sf_dir)))


def exactly_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    prepare(spark)
    return exact_dedup.drop_exact_duplicates(docs)


def nearly_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked fingerprints (three-word shingles, up to three differing bits), the document with the smallest id."""
    prepare(spark)
    return simhash.drop_near_duplicates(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the sequences."""
    prepare(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", good_quality),
    ("toxicity", not_toxic),
    ("exact dedup", exactly_once),
    ("near dedup", nearly_once),
    ("packing", packed),
]

#: The learned stages and the hashes have no SQL; tests hold every stage against a plain version of its rule.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
