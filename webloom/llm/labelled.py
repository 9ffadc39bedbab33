"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a model is fitted on, at most.
SAMPLE_ROWS = 20_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, where: Column | None = None, rows: int = SAMPLE_ROWS,
                    text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(text, label)`` of at most ``rows`` different labelled documents (id and text), those with the
    smallest hashes of their ids.

    Unlabelled and null rows are left out; of contradicting labels the larger counts. Repeated rows count
    once, however many there are. What is sent to every task are ``rows`` ids and hashes at most, so no
    text is shuffled but those chosen.
    """
    known = labels.select(F.col(key).alias("_id"), F.col(label).cast("int").alias("label")).dropna()
    if where is not None:
        known = known.where(where)
    chosen = known.groupBy("_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    whole = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.col(key).alias("doc_id"), F.xxhash64(whole).alias("text_hash"), whole.alias("text"))
    # An id may stand for several texts: the bound is on these.
    pairs = (texts.drop("text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("_id", "text_hash", "label").distinct()
             .orderBy(F.xxhash64("_id"), "_id", "text_hash").limit(rows).withColumnRenamed("text_hash", "_hash"))
    same = (F.col("doc_id") == F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    return texts.join(F.broadcast(pairs), same).dropDuplicates(["_id", "_hash"]).select("text", "label")
