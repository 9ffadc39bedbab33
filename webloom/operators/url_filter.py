"""Rows whose URL is on a list, found without moving the wide columns beside it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.utils import AnalysisException

from webloom.session import materialize

#: Bits for each listed URL, tests for each URL, and bounds of a filter's bits (16 MB at most).
BITS_PER_URL, TESTS = 12, 5
FEWEST_BITS, MOST_BITS = 1 << 12, 1 << 27
#: Listed URLs from which a filter would let too much through.
MOST_URLS = MOST_BITS // 2
#: A scan is narrowed to the files that hold a listed URL if they are no more than these.
MOST_FILES = 10_000
_FILE = "_metadata.file_path"


def bits_for(urls: int) -> int:
    """A power of two."""
    wanted = max(1, urls * BITS_PER_URL - 1).bit_length()
    return min(MOST_BITS, max(FEWEST_BITS, 1 << wanted))


def _positions(url: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(test), url), F.lit(bits)) for test in range(TESTS)]


def bloom_words(urls: DataFrame, bits: int, column: str = "url") -> DataFrame:
    """One row with the filter's bits as an array of ``bits / 64`` numbers.

    Every task first merges its own bits, so at most one row for each number is shuffled.
    """
    positions = urls.select(F.explode(F.array(*_positions(F.col(column), bits))).alias("position"))
    number, bit = F.expr("CAST(position DIV 64 AS INT)"), F.expr("shiftleft(1L, CAST(position % 64 AS INT))")
    set_bits = positions.select(number.alias("number"), bit.alias("word"))
    unset = urls.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("number"), F.lit(0).cast("long").alias("word"))
    words = set_bits.unionByName(unset).groupBy("number").agg(F.bit_or("word").alias("word"))
    ordered = F.array_sort(F.collect_list(F.struct("number", "word")))
    return words.agg(F.transform(ordered, lambda w: w["word"]).alias("words"))


def may_be_listed(url: Column, words: Column, bits: int) -> Column:
    """False only for URLs that are not on the list; null for a null URL."""
    tests = [F.call_function("shiftright", F.get(words, F.floor(position / 64).cast("int")), (position % 64).cast("int")).bitwiseAND(F.lit(1)) == 1
             for position in _positions(url, bits)]
    return F.when(url.isNotNull(), reduce(lambda a, b: a & b, tests))


def _hit_files(rows: DataFrame, urls: DataFrame, passed: Column) -> list[str] | None:
    """The files that hold a listed URL; None if the rows are of no files, or of too many."""
    try:
        narrow = rows.select("url", F.col(_FILE).alias("file"))
    except AnalysisException:
        return None
    hits = narrow.filter(passed).join(urls, "url", "left_semi").select("file").distinct()
    files = [row.file for row in hits.limit(MOST_FILES + 1).collect()]
    return files if len(files) <= MOST_FILES else None


def listed_rows(rows: DataFrame, urls: DataFrame) -> DataFrame:
    """The rows whose ``url`` is among the distinct ``urls``, and a few others that the filter lets through.

    A Bloom filter over the list is tested where the rows lie; only the column ``url`` decides. Rows that
    come straight from files are read twice: first the URLs alone, then the other columns of those
    files that hold a listed one. Nothing but URLs and filter bits is shuffled, however wide the rows are
    and however long the list is; who needs the exact rows joins the narrow results afterwards. For lists beyond
    ``MOST_URLS``, whose filter would let most rows through, the rows themselves are joined.
    """
    count = urls.count()
    if count > MOST_URLS:
        return rows.join(urls, "url", "left_semi")
    if not count:
        return rows.limit(0)
    bits = bits_for(count)
    passed = may_be_listed(F.col("url"), materialize(bloom_words(urls, bits), "url-filter").scalar(), bits)
    files = _hit_files(rows, urls, passed)
    if files is not None:
        rows = rows.filter(F.col(_FILE).isin(files)) if files else rows.limit(0)
    return rows.filter(passed)
