"""Named queries of the operators over the driver tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import byte_pairs, centroids, chat, exact_dedup, lattice, neighbours, packing, pieces, quality, simhash, spelling, token_count, toxicity
from webloom.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    """Register a function of ``(spark, sf_dir)``."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            prepare(spark)
            return build(spark, folder)

        QUERIES[name] = run
        if check is not None:
            CHECKS[name] = check.strip()
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def remainder(divisor: int, key: str = "doc_id"):
    """The fold of a document."""
    return F.crc32(F.col(key).cast("string")) % divisor


@query("op1_toxicity")
def toxicity_scores(spark, folder):
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels"), remainder(5, "_id") != 0)
    held_out = F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out")
    return toxicity.score_texts(docs, model).select("doc_id", held_out, "score", "predicted")


@query("op2_sentencepiece")
def sentencepiece_digests(spark, folder):
    return pieces.round_trip_digests(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op3_nearest_neighbours", """
WITH usable AS (
    SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.v, c.v) AS score
    FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank, vec_id, score FROM pairs
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10
""")
def nearest_neighbours(spark, folder):
    vectors = table(spark, folder, "embeddings")
    return neighbours.nearest(vectors.where("vec_id % 100 = 0"), vectors, 10)


@query("op4_simhash_near_dedup")
def simhash_near_dedup(spark, folder):
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query("op5_packing")
def cost_balanced_packing(spark, folder):
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op6_lm_scoring")
def lm_scores(spark, folder):
    return lattice.score_texts(table(spark, folder, "documents"), remainder(7) == 2, public_tokenizers.path("piece_bpe_32k.model"))


@query("op7_exact_dedup", """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""")
def exact_duplicates(spark, folder):
    return exact_dedup.exact_duplicates(table(spark, folder, "documents"))


@query("op8_token_counts")
def token_counts(spark, folder):
    return token_count.token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op9_quality_classifier")
def good_documents(spark, folder):
    return quality.select_good(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op10_chat_perspectives", """
WITH turns AS (
    SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS position,
           coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS body
    FROM conversations
), people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM turns WHERE speaker <> 'system'),
lines AS (
    SELECT t.conv_id, perspective, position, turn, speaker,
           CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS chat_role,
           CASE WHEN speaker NOT IN ('system', perspective) THEN ' name=' || speaker ELSE '' END AS called, body,
           speaker = perspective AS trained
    FROM turns t JOIN people p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), segments AS (
    SELECT *, '<|' || chat_role || called || '|>' || chr(10) AS head, body || '<|end|>' || chr(10) AS tail FROM lines
), placed AS (
    SELECT *, sum(length(head) + length(tail)) OVER (PARTITION BY conv_id, perspective ORDER BY position) AS ends FROM segments
)
SELECT conv_id, perspective, position, turn, chat_role, CASE WHEN called <> '' THEN speaker END AS name, head || tail AS segment,
       (ends - length(head) - length(tail))::BIGINT AS start, ends::BIGINT AS "end",
       CASE WHEN trained THEN (ends - length(tail))::BIGINT END AS mask_start,
       CASE WHEN trained THEN (ends - 1)::BIGINT END AS mask_end
FROM placed
""")
def chat_perspectives(spark, folder):
    return chat.perspectives(table(spark, folder, "conversations"))


@query("op11_bpe")
def bpe_digests(spark, folder):
    return byte_pairs.round_trip_digests(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def _k_means_sql(k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64) -> str:
    """Lloyd's rounds without bounds: all distances, one table for each assignment and each move."""
    distance = "list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT"
    parts = [f"""kept AS MATERIALIZED (
    SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""", f"""centroids0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS k, v FROM kept QUALIFY k < {k}
)"""]
    for t in range(rounds + 1):
        parts.append(f"""nearest{t} AS MATERIALIZED (
    SELECT p.row, min({distance} * {k} + c.k) AS least FROM kept p CROSS JOIN centroids{t} c GROUP BY p.row
)""")
        if t < rounds:
            parts.append(f"""sums{t} AS (
    SELECT least % {k} AS k, i, sum(v[i]) AS s, count(*)::HUGEINT AS n FROM kept JOIN nearest{t} USING (row), range(1, {size + 1}) r(i) GROUP BY ALL
), moved{t} AS (
    SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM sums{t} GROUP BY k
), centroids{t + 1} AS MATERIALIZED (
    SELECT c.k, coalesce(m.v, c.v) AS v FROM centroids{t} c LEFT JOIN moved{t} m USING (k)
)""")
    joined = ",\n".join(parts)
    return f"""
WITH {joined}
SELECT vec_id, (least % {k})::INTEGER AS cluster, (least // {k})::BIGINT AS distance,
       sum(least // {k}) OVER (PARTITION BY least % {k})::BIGINT AS cluster_inertia, sum(least // {k}) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM kept JOIN nearest{rounds} USING (row) JOIN centroids{rounds} c ON c.k = least % {k}
"""


@query("op12_centroid_clustering", _k_means_sql())
def centroid_clusters(spark, folder):
    return centroids.cluster_vectors(table(spark, folder, "embeddings")).drop("n_distances")


@query("op13_spelling_variants")
def spelling_variants(spark, folder):
    return spelling.variant_groups(table(spark, folder, "documents"))
