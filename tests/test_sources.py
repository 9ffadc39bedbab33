from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from webloom.functions.files import run_path, safe_run_name
from webloom.operators.filters import clean_counts, clean_rows, non_blank, removed_examples
from webloom.plans.prompt_documents import title_document, title_files
from webloom.session import materialize, work_folder
from webloom.sources import sinks
from webloom.sources.media import media_inventory
from webloom.sources.tables import find_url_column, read_table, read_url_list, require_column


def test_report_reads_back(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", now\nnext', "چرا"), (2, None, "\\")], "n INT, t STRING, u STRING")
    path = str(tmp_path / "report.csv")
    sinks.write_report(df, path)
    back = read_table(spark, path)
    assert sorted(map(tuple, back.collect())) == [("1", 'say "hi", now\nnext', "چرا"), ("2", None, "\\")]
    with pytest.raises(Exception, match="already exists"):
        sinks.write_report(df, path)


def test_formats_by_extension(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "n BIGINT, t STRING")
    for kind in ("json", "orc", "parquet"):
        df.write.format(kind).save(str(tmp_path / f"t.{kind}"))
        assert [tuple(r) for r in read_table(spark, str(tmp_path / f"t.{kind}")).select("n", "t").collect()] == [(1, "x")]
    with pytest.raises(ValueError, match="spreadsheets"):
        read_table(spark, "t.xlsx")


def test_columns_are_found_or_named(spark):
    df = spark.createDataFrame([("a", "b", "c")], ["Address", " LINKS ", "x"])
    assert find_url_column(df) == " LINKS "
    assert find_url_column(df.select("x", "Address")) == "Address"
    assert find_url_column(df.select("x")) == "x"
    with pytest.raises(ValueError, match=r"'title' not found; available: \['Address', ' LINKS ', 'x'\]"):
        require_column(df, "title")


def test_url_list_is_the_first_column(spark):
    df = spark.createDataFrame([(1.5, 1), (None, 2)], "any DOUBLE, n INT")
    assert [tuple(r) for r in read_url_list(df, keep=("n",)).collect()] == [(1, "1.5")]


def test_clean_rows_and_counts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a?OTP?x", None, "b", "otp?", "otp"])], "i INT, t STRING")
    assert [r.i for r in clean_rows(df, "t", "otp?").orderBy("i").collect()] == [1, 2, 4]
    assert tuple(clean_counts(df, "t", "otp?").first()) == (5, 2, 3)
    assert [r.t for r in removed_examples(df, "t", "OTP", "i", 2).collect()] == ["a?OTP?x", "otp?"]
    assert [r.i for r in clean_rows(df, "t", "").collect()] == [1]
    assert [r.t for r in non_blank(df.withColumn("t", F.concat(F.lit("  "), "t")), "t").orderBy("i").collect()][0] == "a?OTP?x"


def test_crawl_report_has_two_tables(spark, tmp_path):
    pages = spark.createDataFrame([("u", "t", "d", "c", "m", "h", "200")],
                                  "url STRING, title STRING, description STRING, canonical STRING, meta_robots STRING, h1 STRING, status_code STRING")
    links = spark.createDataFrame([("u", "v", "x", "404")], "source STRING, destination STRING, anchor_text STRING, status_code STRING")
    run = run_path(str(tmp_path), "a.example:8080", datetime(2024, 1, 2, 3, 4, 5))
    assert run.endswith("/a.example_8080_2024-01-02_03-04-05")
    sinks.write_crawl_report(pages, links, run)
    assert spark.read.csv(f"{run}/crawl_data", header=True).columns == [
        "URL", "Title", "Description", "Canonical", "Meta Robots", "H1", "Status Code"]
    assert [tuple(r) for r in spark.read.csv(f"{run}/internal_links", header=True).collect()] == [("u", "v", "x", "404")]


def test_safe_run_name(spark):
    row = spark.range(1).select(safe_run_name(F.lit('a<b>:"/\\|?*c')).alias("n")).first()
    assert row.n == "a_b________c"


def titles_and_replies(spark):
    titles = spark.createDataFrame([(1, " One? "), (2, "Two"), (3, "One!"), (4, " "), (5, "؟"), (6, None)], "row_id BIGINT, title STRING")
    replies = spark.createDataFrame([(1, '{"text":"1"}'), (2, '{"choices":[{"message":{"content":" two "}}]}'), (3, '{"text":"3"}')],
                                    "row_id BIGINT, reply_json STRING")
    return titles, replies


def test_markdown_files(spark, tmp_path):
    files = title_files(*titles_and_replies(spark))
    got = {r.filename: r.content for r in files.collect()}
    # Equal names: the last row wins.
    assert got["One.md"] == "# One!\n\n3\n" and set(got) == {"One.md", "Two.md", "title_5.md"}
    sinks.write_markdown_files(files, str(tmp_path / "md"))
    (written,) = Path(tmp_path / "md" / "filename=One.md").glob("*.txt")
    assert written.read_text() == "# One!\n\n3\n"


def test_markdown_document(spark, tmp_path):
    blocks = title_document(*titles_and_replies(spark))
    text = "".join(f"## {t}\n\n{b}\n\n---\n\n" for t, b in [
        ("One?", "**Failed to generate structure**"), ("Two", "two"), ("One!", "**Failed to generate structure**"),
        ("؟", "**Failed to generate structure**")])
    rows = blocks.orderBy("row_id").collect()
    assert "".join(r.block for r in rows) == text
    assert all(text[r.start:].startswith(r.block) for r in rows)
    sinks.write_markdown_document(blocks, str(tmp_path / "doc"))
    parts = sorted(Path(tmp_path / "doc").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == text


def test_media_inventory(spark, tmp_path):
    for name in ("20261116/video.MP4", "motion_reports/ignored.mp4", "x/Motion_Reports/y/ignored.mp4", "top.avi", "note.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    rows = media_inventory(spark, str(tmp_path)).orderBy("path").collect()
    assert [r.path.removeprefix(str(tmp_path)) for r in rows] == ["/20261116/video.MP4", "/top.avi"]
    assert rows[0].size == 5
    assert rows[0].mtime == pytest.approx((tmp_path / "20261116/video.MP4").stat().st_mtime_ns / 1000, abs=1e6)


def test_materialize_uses_the_working_folder(spark):
    df = materialize(spark.range(3), "three")
    assert df.count() == 3 and all(work_folder(spark) in f for f in df.inputFiles())
