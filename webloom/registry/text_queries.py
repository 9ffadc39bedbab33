"""Queries over keywords, titles, replies and plain texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.functions import text as tx
from webloom.operators import documents as docs, filters
from webloom.plans.keyword_cleaning import clean_keywords
from webloom.plans.prompt_documents import replied_titles, title_document, title_files
from webloom.registry.catalog import collapsed, query, stripped
from webloom.sources.tables import read_table

KEYWORDS = {"column": "query", "min_words": 3, "pattern": "the|und|la"}
PERSIAN = "coalesce(" + collapsed(
    "replace(replace(replace(replace(query, chr(8204), ''), chr(8205), ''), chr(8294), ''), chr(8295), '')"
) + ", '')"
WORDS = f"CASE WHEN {PERSIAN} = '' THEN 0 ELSE len(string_split({PERSIAN}, ' ')) END"
MATCH = f"regexp_matches({PERSIAN}, 'the|und|la', 'i')"
TITLES = f"t AS (SELECT row_id, {stripped('title')} AS title FROM fx_titles WHERE {stripped('title')} <> '')"
# A reply that is no JSON is a failed request.
JSON = "CASE WHEN json_valid(reply_json) THEN reply_json END"
REPLY = stripped(
    f"coalesce(json_extract_string({JSON}, '$.response'), json_extract_string({JSON}, '$.text'), "
    f"json_extract_string({JSON}, '$.content'), json_extract_string({JSON}, '$.message'), {JSON})"
)
CHAT = stripped(f"json_extract_string({JSON}, '$.choices[0].message.content')")
FAILED = "'**Failed to generate structure**'"
BODY = f"CASE WHEN coalesce(reply, '') = '' THEN {FAILED} ELSE reply END"
SAFE = "trim(regexp_replace(title, '[^\\p{L}\\p{N} \\-_()]', '', 'g'), ' ')"
FILENAME = f"CASE WHEN {SAFE} = '' THEN 'title_' || row_id ELSE {SAFE} END"
BASE_PROMPT = "Write an outline.\n"


@query("read_table", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def _(t):
    return read_table(t.spark, t.path("documents")).select("doc_id", "text", "lang", "source", "n_chars")


@query("clean_text", f"SELECT doc_id, coalesce({collapsed('text')}, '') AS clean FROM documents")
def _(t):
    return t.table("documents").select("doc_id", tx.clean_text(F.col("text")).alias("clean"))


@query("collapse_ws", f"SELECT conv_id, turn, {collapsed('text')} AS clean FROM conversations")
def _(t):
    return t.table("conversations").select("conv_id", "turn", tx.collapse_ws(F.col("text")).alias("clean"))


@query("normalize_persian", f"SELECT row_id, {PERSIAN} AS normalized FROM fx_queries", "fx_queries")
def _(t):
    return t.view("fx_queries").select("row_id", tx.normalize_persian(F.col("query")).alias("normalized"))


@query("word_count", f"SELECT row_id, {WORDS} AS words FROM fx_queries", "fx_queries")
def _(t):
    words = tx.word_count(tx.normalize_persian(F.col("query")))
    return t.view("fx_queries").select("row_id", words.cast("long").alias("words"))


@query(
    "keyword_filter",
    f"SELECT row_id, lang, n_chars, query FROM fx_queries WHERE {WORDS} >= 3 AND {MATCH}", "fx_queries",
)
def keyword_filter(t):
    return clean_keywords(t.view("fx_queries"), **KEYWORDS).rows


@query(
    "keyword_funnel",
    f"""SELECT count(*) AS loaded, count(*) FILTER ({WORDS} >= 3) AS after_words,
        count(*) FILTER ({WORDS} >= 3 AND {MATCH}) AS after_pattern,
        count(*) FILTER ({WORDS} >= 3 AND {MATCH}) AS saved FROM fx_queries""", "fx_queries",
)
def _(t):
    return clean_keywords(t.view("fx_queries"), **KEYWORDS).funnel


LITERAL = ".COM/en"
HIT = "coalesce(contains(lower(url), '.com/en'), false)"


@query("clean_rows", f"SELECT row_id, url FROM fx_urls WHERE NOT {HIT}", "fx_urls")
def _(t):
    return filters.clean_rows(t.view("fx_urls"), "url", LITERAL)


@query(
    "clean_counts",
    f"SELECT count(*) AS total, count(*) FILTER ({HIT}) AS removed, count(*) FILTER (NOT {HIT}) AS kept FROM fx_urls",
    "fx_urls",
)
def _(t):
    return filters.clean_counts(t.view("fx_urls"), "url", LITERAL)


@query("removed_examples", f"SELECT row_id, url FROM fx_urls WHERE {HIT} ORDER BY row_id LIMIT 5", "fx_urls")
def _(t):
    return filters.removed_examples(t.view("fx_urls"), "url", LITERAL, "row_id")


@query("non_blank", f"WITH {TITLES} SELECT row_id, title FROM t", "fx_titles")
def _(t):
    return filters.non_blank(t.view("fx_titles"), "title")


@query(
    "prompts",
    f"WITH {TITLES} SELECT row_id, title, 'Write an outline.' || chr(10) || 'title:' || chr(10) || title AS prompt FROM t",
    "fx_titles",
)
def _(t):
    return docs.prompts(filters.non_blank(t.view("fx_titles"), "title"), BASE_PROMPT)


@query("llm_reply", f"SELECT row_id, {REPLY} AS reply FROM fx_replies", "fx_replies")
def _(t):
    return t.view("fx_replies").select("row_id", tx.extract_reply(F.col("reply_json")).alias("reply"))


@query("chat_reply", f"SELECT row_id, {CHAT} AS reply FROM fx_replies", "fx_replies")
def _(t):
    return t.view("fx_replies").select("row_id", tx.extract_chat_reply(F.col("reply_json")).alias("reply"))


ANSWERED = f"""{TITLES}, a AS (
  SELECT t.row_id, t.title, {REPLY} AS reply, {CHAT} AS chat FROM t LEFT JOIN fx_replies r USING (row_id))"""


@query(
    "markdown_block",
    f"""WITH {ANSWERED} SELECT row_id,
        '## ' || title || chr(10) || chr(10) || {BODY} || chr(10) || chr(10) || '---' || chr(10) || chr(10) AS section,
        '# ' || title || chr(10) || chr(10) || {BODY} || chr(10) AS file FROM a""", "fx_titles fx_replies",
)
def _(t):
    rows = replied_titles(t.view("fx_titles"), t.view("fx_replies"))
    title, reply = F.col("title"), F.col("reply")
    return rows.select(
        "row_id", tx.markdown_block(title, reply, "section").alias("section"),
        tx.markdown_block(title, reply, "file").alias("file"),
    )


@query("safe_filename", f"SELECT row_id, {FILENAME} AS filename FROM fx_titles", "fx_titles")
def _(t):
    return t.view("fx_titles").select("row_id", tx.safe_filename(F.col("title"), F.col("row_id")).alias("filename"))


@query(
    "markdown_files",
    f"""WITH {ANSWERED} SELECT {FILENAME} || '.md' AS filename, max(row_id) AS row_id,
        arg_max('# ' || title || chr(10) || chr(10) || {BODY} || chr(10), row_id) AS content
        FROM a GROUP BY 1""", "fx_titles fx_replies",
)
def _(t):
    return title_files(t.view("fx_titles"), t.view("fx_replies"))


@query(
    "markdown_document",
    f"""WITH {ANSWERED}, b AS (SELECT row_id, '## ' || title || chr(10) || chr(10)
        || CASE WHEN coalesce(chat, '') = '' THEN {FAILED} ELSE chat END
        || chr(10) || chr(10) || '---' || chr(10) || chr(10) AS block FROM a)
        SELECT row_id, block, CAST(coalesce(sum(length(block)) OVER (
          ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM b""",
    "fx_titles fx_replies",
)
def _(t):
    return title_document(t.view("fx_titles"), t.view("fx_replies"))
