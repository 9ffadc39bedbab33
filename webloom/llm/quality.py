"""Quality by importance resampling with hashed n-gram models.

Two generative models count n-grams in hashed buckets: the target from texts labelled good (a bounded
sample), the raw one from all texts. The n-grams are words, pairs of words, and pairs of word shapes
with a mark for repetition. The log ratio of a text under the two models is its importance; with
independent Gumbel noise added, the k largest are a weighted sample without replacement.

Labels only say where the cut lies: the mean log ratio that best separates texts labelled good and bad
is taken off each n-gram, and k is the number of texts above it. Where the two kinds lie far apart the
noise changes nothing; near the cut it decides. Texts that tie at the cut are all kept.

Null and empty texts have log ratio zero. Long texts are counted whole, in slices. The noise is a hash of
the id, the same in every run; rows without an id share theirs, and so do repeated rows. Without labels
of both kinds nothing is cut. An empty table gives no rows. Other columns are not read; ``keep_good``
carries them, whatever their names but ``_draw_of_text``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.labelled import SAMPLE_ROWS, labelled_sample
from webloom.llm.words import filled, split_words, text_slices
from webloom.session import materialize

#: Numbers of buckets, powers of two.
WORD_BUCKETS, SHAPE_BUCKETS = 1 << 16, 1 << 13
BUCKETS = WORD_BUCKETS + SHAPE_BUCKETS
#: Strength of the raw model as the target's prior, in n-grams for each bucket.
PRIOR = 2.0
#: Runs of a kind of character, and the letter that stands for each in a word's shape.
SHAPES = ((r"\p{Lu}+", "A"), (r"[\p{Ll}\p{Lo}\p{M}]+", "a"), (r"\p{N}+", "0"))
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def shapes(words: pa.Array) -> pa.Array:
    """Runs of capitals, small letters and digits as one letter each; other characters stay."""
    for pattern, letter in SHAPES:
        words = pc.replace_substring_regex(words, pattern, letter)
    return words


def hashes(words: pa.Array) -> np.ndarray:
    """A number for each string, the same in every run."""
    return hash_array(words.to_numpy(zero_copy_only=False), categorize=False) if len(words) else np.zeros(0, np.uint64)


def _bucket(values: np.ndarray, size: int) -> np.ndarray:
    return ((values * FACTOR) >> np.uint64(65 - size.bit_length())).astype(np.int64)


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams, and the text each belongs to."""
    words = split_words(texts, None)
    forms = shapes(words.dictionary).dictionary_encode()
    word = (hashes(words.dictionary) >> np.uint64(24))[words.codes]
    form = (hashes(forms.dictionary) >> np.uint64(24))[forms.indices.to_numpy(zero_copy_only=False)][words.codes]
    owner = np.repeat(np.arange(len(texts)), np.diff(words.offsets))
    inside = owner[1:] == owner[:-1] if len(owner) else np.zeros(0, bool)
    again = (words.codes[1:] == words.codes[:-1]).astype(np.uint64)
    singles = _bucket(word + np.uint64(1), WORD_BUCKETS)
    pairs = _bucket(word[:-1] * np.uint64(31) + (word[1:] << np.uint64(20)), WORD_BUCKETS)[inside]
    pair_forms = WORD_BUCKETS + _bucket(form[:-1] * np.uint64(31) + (form[1:] << np.uint64(20)) + again, SHAPE_BUCKETS)[inside]
    return np.concatenate([singles, pairs, pair_forms]), np.concatenate([owner, owner[1:][inside], owner[1:][inside]])


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Counts of a column ``text`` over all rows; each task sends its sums, one for each bucket at most."""

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in text_slices(batches):
            total += np.bincount(grams(filled(batch.column("text")))[0], minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    found = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect()
    counts = np.zeros(BUCKETS, np.int64)
    for bucket, n in found:
        counts[bucket] = n
    return counts


@dataclass(frozen=True)
class Model:
    """Log ratio of each bucket, the cut taken off each n-gram."""

    ratios: np.ndarray
    cut: float = 0.0

    def log_weights(self, texts: pa.Array, cut: float) -> tuple[np.ndarray, np.ndarray]:
        """Sum of log ratios above the cut, and number of n-grams, for each text."""
        buckets, owner = grams(texts)
        sums = np.bincount(owner, self.ratios[buckets] - cut, minlength=len(texts))
        return sums, np.bincount(owner, minlength=len(texts))


def best_cut(values: np.ndarray, good: np.ndarray) -> float:
    """The middle of the gap that separates the most good from the most bad values."""
    if not good.any() or good.all():
        return -np.inf
    order = np.argsort(values, kind="stable")
    values, good = values[order], good[order]
    kept = 1 - np.cumsum(good) / good.sum()
    dropped = np.cumsum(~good) / (~good).sum()
    gain = np.r_[1.0, kept + dropped]
    best = int(np.flatnonzero(gain >= gain.max() - 1e-12)[-1]) if gain.max() > 1 else 0
    if not best:
        return -np.inf
    return float((values[best - 1] + values[best]) / 2) if best < len(values) else float(values[-1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS,
        text: str = "text", key: str = "doc_id") -> Model:
    """Both models and the cut; the labelled sample is bounded by ``rows``, the raw model sees all texts."""
    sample = materialize(labelled_sample(docs, labels, label, None, rows, text, key), "quality-sample")
    target = bucket_counts(sample.where("label = 1"))
    raw = bucket_counts(docs.select(F.col(text).alias("text")))
    p_raw = (raw + 0.5) / (raw.sum() + 0.5 * BUCKETS)
    p_target = (target + PRIOR * BUCKETS * p_raw) / (target.sum() + PRIOR * BUCKETS)
    model = Model(np.log(p_target / p_raw))

    def means(batches):
        for batch in text_slices(batches):
            sums, n = model.log_weights(filled(batch.column("text")), 0.0)
            yield pa.RecordBatch.from_arrays([pa.array(sums / np.maximum(n, 1)), batch.column("label")], ["mean", "label"])

    table = sample.mapInArrow(means, "mean double, label int").toPandas()  # two numbers for each sampled row
    return Model(model.ratios, best_cut(table["mean"].to_numpy(np.float64), table.label.to_numpy() == 1))


def weight_column(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """``struct(log_weight, n_grams)`` of a text column: above zero if it is likelier good."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model.ratios.astype(np.float64))  # one number for each bucket
    cut = model.cut if np.isfinite(model.cut) else 0.0

    @F.arrow_udf("log_weight double, n_grams long")
    def weight_of(texts: pa.Array) -> pa.Array:
        own = Model(shared.value)
        parts = [own.log_weights(filled(b.column("text")), cut) for b in text_slices([pa.RecordBatch.from_arrays([texts], ["text"])])]
        sums, n = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0), np.zeros(0, np.int64))
        return pa.StructArray.from_arrays([pa.array(sums, pa.float64()), pa.array(n.astype(np.int64))], ["log_weight", "n_grams"])

    return weight_of(F.col(text))


def gumbel(key: str, seed: int = 0) -> Column:
    """Standard Gumbel noise from a hash of the key."""
    number = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 11)
    return -F.log(-F.log((number + F.lit(0.5)) / F.lit(float(2**53))))


def kth_largest(values: DataFrame, column: str, k: int, bins: int = 1024) -> float:
    """The k-th largest value of a written table: a range around it is cut into bins until it is alone.

    The driver sees one count for each bin.
    """
    low, high = values.agg(F.min(column), F.max(column)).first()
    above = 0  # values over the range
    while low < high:
        width = (high - low) / bins
        inside = values.where((F.col(column) >= low) & (F.col(column) <= high))
        if low + width == low or high - width == high:
            # Neighbouring doubles: no more different values than a bin or two has room for.
            for value, n in inside.groupBy(column).agg(F.count("*")).orderBy(F.desc(column)).collect():
                above += n
                if above >= k:
                    return value
        number = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1))
        counts = {r[0]: r[1:] for r in inside.groupBy(number.alias("bin")).agg(F.count("*"), F.min(column), F.max(column)).collect()}
        for b in sorted(counts, reverse=True):
            n, least, most = counts[b]
            if above + n >= k:
                low, high = least, most
                break
            above += n
        if above + n == k:
            return low
    return low


def resample(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id", seed: int = 0) -> tuple[DataFrame, float]:
    """``(doc_id, n_grams, log_weight, draw)`` for each row, written, and the smallest draw that is kept."""
    scored = docs.select(F.col(key).alias("doc_id"), weight_column(docs, model, text).alias("w"), gumbel(key, seed).alias("noise"))
    drawn = materialize(scored.select("doc_id", "w.n_grams", "w.log_weight", (F.col("w.log_weight") + F.col("noise")).alias("draw")), "draws")
    k = drawn.where("log_weight >= 0").count() if np.isfinite(model.cut) else 0
    return drawn, kth_largest(drawn, "draw", k) if k else (-np.inf if not np.isfinite(model.cut) else np.inf)


def select_good(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(doc_id, n_grams, log_weight, draw, kept)`` for each row."""
    drawn, least = resample(docs, fit(docs, labels, text=text, key=key), text, key)
    return drawn.withColumn("kept", F.col("draw") >= F.lit(float(least)))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 0) -> DataFrame:
    """The sampled rows, with all their columns: each row is weighed again where it lies."""
    model = fit(docs, labels, text=text, key=key)
    _, least = resample(docs, model, text, key, seed)
    mark = "_draw_of_text"
    draw = weight_column(docs, model, text)["log_weight"] + gumbel(key, seed)
    return docs.withColumn(mark, draw).where(F.col(mark) >= F.lit(float(least))).drop(mark)
