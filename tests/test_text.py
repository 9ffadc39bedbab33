import re

import pytest
from hypothesis import HealthCheck, Phase, given, settings, strategies as st
from pyspark.sql import functions as F

from webloom.functions import text as tx
from webloom.functions.text import WHITESPACE
from webloom.operators.filters import keyword_filter, keyword_funnel

# Whitespace-heavy texts, with the odd neighbour such as a zero-width space.
TEXTS = st.lists(
    st.text(st.sampled_from(WHITESPACE + "\x00​‌‍⁦⁧abÉ~!"), max_size=12), min_size=150, max_size=200
)
BATCH = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck), phases=[Phase.generate])


def values(spark, texts, column):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    return [r[0] for r in rows.orderBy("i").select(column).collect()]


def test_whitespace_is_pythons():
    assert sorted(WHITESPACE) == [chr(i) for i in range(0x110000) if chr(i).isspace()]


@BATCH
@given(TEXTS)
def test_whitespace_functions_follow_python(spark, texts):
    col = F.col("t")
    assert values(spark, texts, tx.strip(col)) == [t.strip() for t in texts]
    assert values(spark, texts, tx.collapse_ws(col)) == [" ".join(t.split()) for t in texts]
    assert values(spark, texts, tx.clean_text(col)) == [re.sub(r"\s+", " ", t.replace("\0", " ")).strip() for t in texts]


@BATCH
@given(TEXTS)
def test_persian_and_word_count_follow_python(spark, texts):
    def plain(text):
        return " ".join(text.translate(dict.fromkeys((0x200C, 0x200D, 0x2066, 0x2067))).split())

    normal = tx.normalize_persian(F.col("t"))
    assert values(spark, texts, normal) == [plain(t) for t in texts]
    assert values(spark, texts, tx.word_count(normal)) == [len(plain(t).split()) for t in texts]


def test_nulls(spark):
    col = F.col("t")
    assert values(spark, [None], tx.clean_text(col)) == [""]
    assert values(spark, [None], tx.normalize_persian(col)) == [""]
    assert values(spark, [None, "x"], tx.contains_ci(col, "")) == [False, True]
    assert values(spark, [None, ""], tx.regex_search_ci(col, ".*")) == [False, False]


def test_searches_ignore_case(spark):
    col = F.col("t")
    assert values(spark, ["A.B", "axb", "ÄRGER"], tx.contains_ci(col, "a.b")) == [True, False, False]
    assert values(spark, ["Warum ÄRGER", "x"], tx.regex_search_ci(col, "ärger|y")) == [True, False]


def test_replies(spark):
    replies = [
        '{"response":" r ","text":"no"}', '{"response":""}', '{"message":"m"}', '{"other":1}', None,
        '{"choices":[{"message":{"content":" k "}}]}',
    ]
    assert values(spark, replies[:5], tx.extract_reply(F.col("t"))) == ["r", "", "m", '{"other":1}', None]
    assert values(spark, ["<html>502 Bad Gateway</html>", ""], tx.extract_reply(F.col("t"))) == [None, None]
    assert values(spark, replies[4:], tx.extract_chat_reply(F.col("t"))) == [None, "k"]


def test_markdown_and_names(spark):
    title, reply = F.lit("T"), F.col("t")
    failed = "**Failed to generate structure**"
    assert values(spark, ["x", "", None], tx.markdown_block(title, reply, "file")) == [
        "# T\n\nx\n", f"# T\n\n{failed}\n", f"# T\n\n{failed}\n"]
    assert values(spark, ["x"], tx.markdown_block(title, reply, "section")) == ["## T\n\nx\n\n---\n\n"]
    names = values(spark, ["  a/b: c? ", "???", "چرا (1)_x-y"], tx.safe_filename(F.col("t"), F.col("i") + 1))
    assert names == ["ab c", "title_2", "چرا (1)_x-y"]


def test_truncate_and_prompt(spark):
    assert values(spark, ["abc", "abcd"], tx.truncate_display(F.col("t"), 3)) == ["abc", "abc..."]
    assert values(spark, ["x"], tx.build_prompt("base", F.col("t"))) == ["base\ntitle:\nx"]


def test_keyword_filter_keeps_columns_and_values(spark):
    df = spark.createDataFrame([(1, " چرا‌ این  کار "), (2, "کجا"), (3, None), (4, "a b")], "n INT, q STRING")
    kept = keyword_filter(df, "q", min_words=2, pattern="چرا|کجا")
    assert kept.columns == ["n", "q"]
    assert kept.collect() == df.filter("n = 1").collect()
    assert keyword_filter(df, "q").count() == 4
    assert keyword_funnel(df, "q", 2, "چرا|کجا").first().asDict() == {
        "loaded": 4, "after_words": 2, "after_pattern": 1, "saved": 1}


@pytest.mark.parametrize("min_words, pattern", [(2, "a"), (2, None), (None, "a"), (None, None), (0, "A"), (3, "^x")])
def test_keyword_stages(spark, min_words, pattern):
    texts = [None, "", " ", "a", "x", "a\u200cb c", " x  a  b ", "b b", "x a b c", "A A A", "\u00a0x\u2003y z"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, q string")
    normal = [" ".join((t or "").replace("\u200c", "").split()) for t in texts]
    enough = [min_words is None or len(t.split()) >= min_words for t in normal]
    found = [not pattern or bool(t and re.search(pattern, t, re.I)) for t in normal]
    kept = [i for i in range(len(texts)) if enough[i] and found[i]]
    assert [r.n for r in keyword_filter(df, "q", min_words, pattern).orderBy("n").collect()] == kept
    want = {"loaded": len(texts), "saved": len(kept)}
    want |= {"after_words": sum(enough)} if min_words is not None else {}
    want |= {"after_pattern": len(kept)} if pattern else {}
    assert keyword_funnel(df, "q", min_words, pattern).first().asDict() == want


def test_keywords_are_normalised_once(spark):
    """The plan holds the two replacements of the normalisation once, in the filter and in the counts."""
    df = spark.range(3).selectExpr("concat('a b ', id) q")
    for result in (keyword_filter(df, "q", 2, "a"), keyword_funnel(df, "q", 2, "a")):
        assert result._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 2
