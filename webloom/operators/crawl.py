"""Breadth-first walk over the link graph of a stored snapshot."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from webloom.session import new_folder

_KEY = ["site", "url"]
#: Pages of one bucket on average: what a round opens for a single URL.
PAGES_PER_BUCKET = 500_000


def bucket_of(buckets: int) -> Column:
    """The bucket of a URL, the same for its links and for its mark of having been reached."""
    return F.pmod(F.xxhash64(*_KEY), F.lit(buckets)).cast("int")


class Buckets:
    """A table ``site, url, ...`` in the shared folder, one folder per hash bucket.

    The driver holds the numbers of the buckets that have rows, never a row.
    """

    def __init__(self, spark: SparkSession, label: str, columns: str, buckets: int) -> None:
        self.spark, self.buckets = spark, buckets
        self.folder = new_folder(spark, label)
        self.schema = f"{columns}, bucket INT"
        self.filled: set[int] = set()

    def add(self, rows: DataFrame) -> set[int]:
        """Append rows, each bucket as one file; returns the buckets they went to."""
        if self.buckets == 1:
            dealt = rows.withColumn("bucket", F.lit(0))
        else:
            dealt = rows.withColumn("bucket", bucket_of(self.buckets)).repartition("bucket").sortWithinPartitions("bucket", *_KEY)
        # Known from the write itself; no further job asks for it.
        seen = Observation()
        dealt.observe(seen, F.collect_set("bucket").alias("buckets")).write.mode("append").partitionBy("bucket").parquet(self.folder)
        new = set(seen.get["buckets"])
        self.filled |= new
        return new

    def read(self, numbers: Iterable[int] | None = None) -> DataFrame:
        """The rows of these buckets; no file of another one is listed or opened."""
        wanted = sorted(self.filled if numbers is None else self.filled & set(numbers))
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        if len(wanted) == len(self.filled):
            return self.spark.read.schema(self.schema).parquet(self.folder)
        return self.spark.read.schema(self.schema).option("basePath", self.folder).parquet(
            *(f"{self.folder}/bucket={number}" for number in wanted))


class Walk:
    """The state of a walk: the links by page, the URLs reached so far, and the last round's part of them."""

    def __init__(self, starts: DataFrame, adjacency: DataFrame, buckets: int | None = None) -> None:
        spark = starts.sparkSession
        links = adjacency.select(*_KEY, "targets").filter(F.size("targets") > 0)
        count = buckets or max(1, -(-links.count() // PAGES_PER_BUCKET))
        names = starts.select(*_KEY).schema.toDDL()
        self.links = Buckets(spark, "links", f"{names}, targets ARRAY<STRING>", count)
        self.links.add(links)
        self.reached = Buckets(spark, "reached", f"{names}, depth INT", count)
        self.depth = 0
        self.frontier = self.reached.add(starts.select(*_KEY).distinct().withColumn("depth", F.lit(0)))

    def targets(self) -> DataFrame:
        """What the last round's URLs link to: only the buckets that hold one of them are opened."""
        last = self.reached.read(self.frontier).filter(F.col("depth") == self.depth).select(*_KEY)
        found = self.links.read(self.frontier).join(last, _KEY)
        return found.select("site", F.explode("targets").alias("url")).distinct()

    def step(self) -> bool:
        """One round; whether it reached anything new."""
        spark, found = self.reached.spark, self.targets()
        numbers = self.frontier
        if self.reached.buckets > 1:
            candidates = Buckets(spark, "candidates", self.reached.schema.rsplit(", depth INT", 1)[0], self.reached.buckets)
            numbers = candidates.add(found)
            found = candidates.read().select(*_KEY)
        known = self.reached.read(numbers).select(*_KEY)
        self.depth += 1
        self.frontier = self.reached.add(found.join(known, _KEY, "left_anti").withColumn("depth", F.lit(self.depth)))
        return bool(self.frontier)


def crawl_bfs(starts: DataFrame, adjacency: DataFrame, max_depth: int | None = None, buckets: int | None = None) -> DataFrame:
    """Every URL reached from the start URLs, with its depth.

    ``starts`` has ``site, url``; ``adjacency`` is a stored table with one row per
    parsable page: ``site, url, targets``. URLs without a page (missing or failing ones)
    are reached but lead nowhere.

    The links are written once, apart from all other columns, into hash buckets of their page's
    URL; the URLs reached are appended to buckets of the same hash. A round opens the link buckets
    that hold a URL of the round before, and compares what it finds with the reached URLs of the
    same buckets only: a long chain costs a bucket per step, not the graph. Plans do not grow, and a
    lost executor costs one round at most. Popular targets shrink to one row per task before the
    shuffle of ``distinct``; small frontiers are broadcast by their written size.
    """
    walk = Walk(starts, adjacency, buckets)
    while (max_depth is None or walk.depth < max_depth) and walk.step():
        pass
    return walk.reached.read().select(*_KEY, "depth")
