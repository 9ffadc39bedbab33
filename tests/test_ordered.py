"""Split windows against plain Python, with pieces so small that groups are cut often."""

import random

import pytest
from pyspark.sql import functions as F

from webloom.operators.documents import markdown_document
from webloom.operators.fetch_log import block_streaks, redirect_status, retry_plan
from webloom.operators.links import link_status
from webloom.operators.split_windows import Folded, Running, fold_runs, row_numbers, running, top_rows

SIZES = [1, 4, 1000]


def sparse_groups(seed, groups=6, longest=60):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        order = sorted(rng.sample(range(400), rng.randint(1, longest)))
        rows += [(g, o, rng.randint(-9, 9)) for o in order]
    return rows


@pytest.mark.parametrize("size", SIZES)
def test_running_values(spark, size):
    rows = sparse_groups(1)
    df = spark.createDataFrame(rows, "g INT, o BIGINT, v INT").repartition(5)
    even = F.when(F.col("v") % 2 == 0, F.struct("o", "v"))
    got = running(df, ["g"], "o", {
        "total": Running("sum", F.col("v")), "before": Running("sum", F.col("v"), False),
        "low": Running("min", F.col("v"), False), "last_even": Running("max", even, False),
    }, size)
    want = []
    for g, o, v in rows:
        earlier = [r for r in rows if r[0] == g and r[1] < o]
        evens = [r[1:] for r in earlier if r[2] % 2 == 0]
        before = sum(r[2] for r in earlier)
        want.append((g, o, v, before + v, before, min((r[2] for r in earlier), default=None), evens[-1] if evens else None))
    result = [tuple(r) for r in got.orderBy("g", "o").collect()]
    assert [(*r[:6], tuple(r[6]) if r[6] else None) for r in result] == want


@pytest.mark.parametrize("size", SIZES)
def test_row_numbers(spark, size):
    rows = sparse_groups(2)
    df = spark.createDataFrame(rows, "g INT, o BIGINT, v INT").repartition(5)
    got = [(r.g, r.o, r.n) for r in row_numbers(df, ["g"], "o", "n", size).collect()]
    assert sorted(got) == [(g, o, 1 + sum(r[0] == g and r[1] < o for r in rows)) for g, o, _ in rows]


@pytest.mark.parametrize("size", SIZES)
def test_fold_runs(spark, size):
    rows = sparse_groups(3)
    firsts = {g: min(r[1] for r in rows if r[0] == g) for g in range(6)}
    df = spark.createDataFrame(rows, "g INT, o BIGINT, v INT").repartition(5)
    starts = (F.col("v") > 5) | F.col("o").isin(*set(firsts.values())) & (
        F.col("o") == F.element_at(F.create_map(*[F.lit(x) for kv in firsts.items() for x in kv]), F.col("g")))
    folded = {"first": Folded("min", F.col("o")), "sum": Folded("sum", F.col("v")), "any": Folded("any", F.col("v") < -7)}
    got = fold_runs(df, ["g"], "o", starts, "run", folded, size)
    want, run = {}, 0
    for g, o, v in rows:
        if o == firsts[g]:
            run = 1
        elif v > 5:
            run += 1
        first, total, found = want.get((g, run), (o, 0, False))
        want[g, run] = (first, total + v, found or v < -7)
    assert {(r.g, r.run): (r.first, r.sum, r.any) for r in got.collect()} == want


@pytest.mark.parametrize("size", SIZES)
def test_null_keys_and_orders_stay(spark, size):
    rows = [(None, 1, 5), (None, 3, 7), (1, None, 2), (1, 2, 4), (1, 9, 1), (None, None, 3)]
    df = spark.createDataFrame(rows, "g INT, o BIGINT, v INT").repartition(3)
    got = running(df, ["g"], "o", {"total": Running("sum", F.col("v")), "n": Running("sum", F.lit(1).cast("long"))}, size)
    want = [(None, None, 3, 3, 1), (None, 1, 5, 8, 2), (None, 3, 7, 15, 3), (1, None, 2, 2, 1), (1, 2, 4, 6, 2), (1, 9, 1, 7, 3)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    runs = fold_runs(df, ["g"], "o", F.coalesce(F.col("o") != 3, F.lit(True)), "run", {"sum": Folded("sum", F.col("v"))}, size)
    assert sorted(map(tuple, runs.collect()), key=str) == sorted(
        [(None, 1, 3), (None, 2, 12), (1, 1, 2), (1, 2, 4), (1, 3, 1)], key=str)


@pytest.mark.parametrize("piece_rows", [1, 3, 1000])
def test_attempts_without_a_site_or_url_stay(spark, piece_rows):
    rows = [(None, 1, "u", 429, None), (None, 2, None, 429, None), (1, 1, None, 429, None), (1, 2, "u", 503, None), (1, 3, "u", 429, None)]
    df = spark.createDataFrame(rows, "site_id BIGINT, seq BIGINT, url STRING, status INT, retry_after STRING")
    streaks = block_streaks(df, piece_rows).select("site_id", "seq", "streak").collect()
    assert sorted(map(tuple, streaks), key=str) == sorted([(None, 1, 1), (None, 2, 2), (1, 1, 1), (1, 2, 2), (1, 3, 3)], key=str)
    plan = retry_plan(df, piece_rows).select("site_id", "seq", "url", "attempt").collect()
    assert sorted(map(tuple, plan), key=str) == sorted(
        [(None, 1, "u", 1), (None, 2, None, 1), (1, 1, None, 1), (1, 2, "u", 1), (1, 3, "u", 2)], key=str)


@pytest.mark.parametrize("piece_rows", [1, 3, 1000])
def test_document_blocks_without_an_id_stay(spark, piece_rows):
    df = spark.createDataFrame([(None, "a", "x"), (4, "b", "yy"), (2, "c", "z")], "row_id BIGINT, title STRING, reply STRING")
    rows = markdown_document(df, piece_rows).collect()
    at = 0
    for row in sorted(rows, key=lambda r: -1 if r.row_id is None else r.row_id):
        assert row.start == at
        at += len(row.block)
    assert len(rows) == 3


def test_top_rows(spark):
    rows = sparse_groups(4)
    df = spark.createDataFrame(rows, "g INT, o BIGINT, v INT")
    got = top_rows(df, ["g"], [F.col("v").desc(), F.col("o")], F.col("o") % 7, 3, "rank")
    want = []
    for g in range(6):
        ranked = sorted((-v, o) for h, o, v in rows if h == g)[:3]
        want += [(g, o, -v, i + 1) for i, (v, o) in enumerate(ranked)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_a_hot_destination_is_split_by_its_size(spark):
    small = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        n = F.col("id")
        links = spark.range(0, 30000, 1, 8).select(
            F.lit("s").alias("site"), F.concat(F.lit("p"), n).alias("source"),
            F.when(n % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("d"), n % 500)).alias("destination"), F.lit("a").alias("anchor_text"))
        statuses = spark.range(500).select(F.lit("s").alias("site"), F.concat(F.lit("d"), n).alias("url"), F.lit("200").alias("status_code")).union(
            spark.createDataFrame([("s", "hot", "301")], "site STRING, url STRING, status_code STRING"))
        got = link_status(links, statuses)
        assert {tuple(r) for r in got.groupBy("status_code").count().collect()} == {("301", 10000), ("200", 20000)}
        got.collect()
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan and "Generate" not in plan
    finally:
        for key in small:
            spark.conf.unset(key)


def fetch_log(seed):
    rng = random.Random(seed)
    rows = []
    for site in range(8):
        for seq in range(1, rng.randint(5, 80)):
            status = rng.choice([429, 503, 403, None, 429, 200, 404][: 5 + site % 3])
            rows.append((site, seq, f"u{rng.randint(0, 3)}", status, rng.choice(["7", " 900 ", "soon", None, "1e2", "-5"])))
    return rows


@pytest.mark.parametrize("piece_rows", [1, 3, 1000])
def test_block_streaks(spark, piece_rows):
    rows = fetch_log(5)
    df = spark.createDataFrame(rows, "site_id BIGINT, seq BIGINT, url STRING, status INT, retry_after STRING")
    want, streak, stopped = [], 0, False
    for site, seq, _, status, _ in rows:
        if seq == 1:
            streak, stopped = 0, False
        if stopped:
            continue
        if status is not None:
            streak = streak + 1 if status in (429, 503, 403) else 0
        stopped = streak >= 5
        want.append((site, seq, streak))
    got = block_streaks(df, piece_rows).select("site_id", "seq", "streak").collect()
    assert sorted(map(tuple, got)) == want


@pytest.mark.parametrize("piece_rows", [2, 1000])
def test_retry_plan(spark, piece_rows):
    rows = fetch_log(6)
    df = spark.createDataFrame(rows, "site_id BIGINT, seq BIGINT, url STRING, status INT, retry_after STRING")
    attempts, want = {}, []
    for site, seq, url, status, after in rows:
        if status in (429, 503):
            n = attempts[site, url] = attempts.get((site, url), 0) + 1
            asked = {"7": 7.0, " 900 ": 900.0, "1e2": 100.0}.get(after, 0.0)
            want.append((site, seq, n, n <= 3, min(300.0, max(30.0 * 2 ** (n - 1), asked)) if n <= 3 else None))
    got = retry_plan(df, piece_rows).select("site_id", "seq", "attempt", "retried", "wait_seconds").collect()
    assert sorted(map(tuple, got)) == want


def test_stopping_attempt_is_not_retried(spark):
    rows = [(1, i, "u" if i % 2 else "v", 429, None) for i in range(1, 8)]
    df = spark.createDataFrame(rows, "site_id BIGINT, seq BIGINT, url STRING, status INT, retry_after STRING")
    plan = retry_plan(block_streaks(df)).orderBy("seq").collect()
    assert [(r.attempt, r.retried, r.wait_seconds) for r in plan] == [
        (1, True, 30.0), (1, True, 30.0), (2, True, 60.0), (2, True, 60.0), (3, False, None)]


def test_redirect_status(spark):
    df = spark.createDataFrame([(1, "a", 2, 200), (1, "a", 0, 301), (1, "a", 1, 302), (1, "b", 0, 404)],
                               "site_id INT, url STRING, hop INT, status INT")
    assert sorted(map(tuple, redirect_status(df).collect())) == [(1, "a", 301, 200), (1, "b", 404, 404)]


def crowd(spark, rows=60_000):
    """A third of the rows in one group, order values 2^20 apart; another group whose values double; the rest dense."""
    return spark.range(rows).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3000 = 1 THEN 'doubling' ELSE concat('g', id % 50) END k",
        "CASE WHEN id % 3 = 0 THEN id * 1048576 WHEN id % 3000 = 1 THEN shiftleft(1L, CAST(id / 3000 AS INT)) ELSE id END o", "id % 7 v")


def test_pieces_are_cut_by_rank(spark):
    from webloom.operators.split_windows import with_piece

    size = 500
    pieces = with_piece(crowd(spark), ["k"], "o", size).groupBy("k", "_piece").agg(
        F.count("*").alias("n"), F.min("o").alias("low"), F.max("o").alias("high")).collect()
    by_group = {}
    for r in pieces:
        by_group.setdefault(r.k, []).append((r._piece, r.low, r.high, r.n))
    assert max(n for group in by_group.values() for *_, n in group) <= size
    # 20,000 rows of the hot group: neither a piece per row nor more than a small multiple of what is needed.
    assert 40 <= len(by_group["hot"]) <= 70 and len(by_group["doubling"]) == 1
    for group in by_group.values():
        group.sort()
        assert all(a[2] < b[1] for a, b in zip(group, group[1:]))  # numbered in the order of their values


def test_sparse_orders_give_the_window(spark):
    from pyspark.sql import Window

    rows = crowd(spark, 12_000).unionByName(spark.createDataFrame([(None, 5, 1), (None, 2**60, 2), ("hot", -(2**40), 3), ("g1", None, 9)], "k string, o long, v long"))
    values = {"s": Running("sum", F.col("v")), "m": Running("max", F.col("v"), include_current=False)}
    got = running(rows, ["k"], "o", values, 100)
    window = Window.partitionBy("k").orderBy("o")
    want = rows.select("*", F.sum("v").over(window.rowsBetween(Window.unboundedPreceding, 0)).alias("s"),
                       F.max("v").over(window.rowsBetween(Window.unboundedPreceding, -1)).alias("m"))
    key = lambda r: str(tuple(r))
    assert sorted(map(key, got.select("k", "o", "v", "s", "m").collect())) == sorted(map(key, want.collect()))
