"""Small tables with the rows that tend to break operators."""

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Names that operators use inside.
    T.StructField("word", T.StringType()), T.StructField("fp", T.LongType()), T.StructField("digest", T.StringType()),
    T.StructField("content", T.StringType()), T.StructField("n", T.LongType()), T.StructField("score", T.DoubleType()),
])
LONG = " ".join(f"word{i % 997} and" for i in range(30_000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog."), (2, "The quick brown fox jumps over the lazy dog."),
    (3, None), (4, ""), (5, "  two  spaces \n and\tmore \n\n"), (6, "ünïcödé 中文 😀 é <|endoftext|> <s>"), (7, LONG),
    (8, "x"), (None, "without an id"), (None, None), (2, "The quick brown fox jumps over the lazy dog."),
    (9, "without an id"), (10, "a" * 5000), (11, "\x00\x1c \x85 ▁▁ ▁x"), (12, "x"), (12, "y"),
    (13, "<|ENDOFTEXT|> <|EndOfText|>, a<|endoftext|>B <|StartOfText|>. <|startoftext|>Über ÜBER. İx. ſa, Ǆz. ÿŸ,"),
]


def documents(spark, texts=TEXTS):
    rows = [(i, t, None, "s", 1, "w", 2, "d", "c", 3, 0.5) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
