"""Queries over URL columns, the fetch log and file names."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.fixed_values import DISPLAY_URL_LENGTH, UNWANTED_EXTENSIONS
from webloom.functions import files as fl, urls as ur
from webloom.functions.text import truncate_display
from webloom.operators import fetch_log as log, filters, state as st
from webloom.registry.catalog import query, stripped
from webloom.session import materialize
from webloom.sources.tables import find_url_column, read_url_list

HOST = r"regexp_extract({0}, '^https?://([^/?#]*)', 1)"
U = stripped("url")
NORMAL = (
    f"CASE WHEN regexp_matches({U}, '^https?:') THEN regexp_extract({U}, '^(https?)', 1) || '://' || "
    f"lower({HOST.format(U)}) || coalesce(nullif(regexp_extract({U}, '^https?://[^/?#]*([^?#]*)', 1), ''), '/') || "
    f"regexp_extract({U}, '^[^?#]*(\\?[^#]+)', 1) ELSE '' END"
)


@query("url_list", "SELECT row_id, url FROM fx_urls WHERE url IS NOT NULL", "fx_urls")
def _(t):
    return read_url_list(t.view("fx_urls").select("url", "row_id"), keep=("row_id",))


@query("url_column", "SELECT row_id, url AS found FROM fx_urls", "fx_urls")
def _(t):
    rows = t.view("fx_urls").select("row_id", F.col("row_id").alias("Address "), F.col("url").alias(" URLs"))
    return rows.select("row_id", F.col(f"`{find_url_column(rows)}`").alias("found"))


@query("normalize_url", f"SELECT row_id, coalesce({NORMAL}, '') AS normalized FROM fx_urls", "fx_urls")
def _(t):
    return t.view("fx_urls").select("row_id", ur.normalize_url(F.col("url")).alias("normalized"))


@query(
    "resolve_url",
    f"""SELECT page_id, regexp_extract(url, '^https?:', 0) || CASE page_id % 4
          WHEN 0 THEN '//' || {HOST.format('url')} || '/x/' || page_id || '?q=1'
          WHEN 2 THEN '//cdn.example/z' ELSE '//' || {HOST.format('url')} || '/' END AS target
        FROM pages WHERE page_id % 4 <> 1
        UNION ALL SELECT page_id, 'https://other.example/A' FROM pages WHERE page_id % 4 = 1""",
)
def _(t):
    href = F.expr("""CASE page_id % 4 WHEN 0 THEN '/x/' || page_id || '?q=1#f'
                     WHEN 1 THEN 'HTTPS://Other.example/A' WHEN 2 THEN '//cdn.example/z' ELSE '/./' END""")
    return t.table("pages").select("page_id", ur.resolve_url(F.col("url"), href).alias("target"))


@query(
    "ensure_scheme",
    f"""SELECT row_id, CASE WHEN url IS NULL THEN '' WHEN {U} = '' THEN ''
        WHEN regexp_matches({U}, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN {U} ELSE 'https://' || {U} END AS url FROM fx_urls""",
    "fx_urls",
)
def _(t):
    return t.view("fx_urls").select("row_id", ur.ensure_scheme(F.col("url")).alias("url"))


@query(
    "ensure_http",
    """SELECT row_id, CASE WHEN starts_with(url, 'http://') OR starts_with(url, 'https://') THEN url
       ELSE 'https://' || url END AS url FROM fx_urls WHERE url IS NOT NULL""", "fx_urls",
)
def _(t):
    rows = t.view("fx_urls").filter("url IS NOT NULL")
    return rows.select("row_id", ur.ensure_http(F.col("url")).alias("url"))


DOMAIN = "CASE WHEN page_id % 2 = 0 THEN upper(regexp_extract(url, '^https?://([^/?#]*)', 1)) ELSE 'Blog.Tionsh.example.com' END"


@query(
    "internal_urls",
    f"SELECT page_id, lower({HOST.format('url')}) = lower({DOMAIN}) AS internal FROM pages",
)
def _(t):
    return t.table("pages").select("page_id", ur.is_internal(F.col("url"), F.expr(DOMAIN)).alias("internal"))


FILE_URL = """regexp_replace(url, '[?#].*$', '') || CASE page_id % 5 WHEN 0 THEN '.PDF' WHEN 1 THEN '.css?v=1'
              WHEN 2 THEN '.html' WHEN 3 THEN '?f=a.pdf' ELSE '.tar.gz;p=1' END"""
ENDINGS = "|".join(e[1:] for e in UNWANTED_EXTENSIONS)


@query(
    "unwanted_ext",
    f"""SELECT page_id, regexp_matches(lower(regexp_replace(regexp_replace({FILE_URL}, '[?#].*$', ''), ';[^/]*$', '')),
        '\\.({ENDINGS})$') AS unwanted FROM pages""",
)
def _(t):
    return t.table("pages").select("page_id", ur.has_unwanted_extension(F.expr(FILE_URL)).alias("unwanted"))


@query(
    "skip_patterns",
    """SELECT page_id, regexp_matches(url, 'utm_') OR contains(url, '?p') OR regexp_matches(url, '/de/\\d+$')
       OR contains(url, '*') OR regexp_matches(url, '/\\p{Lu}+$') OR contains(url, '(?P<a>b)') AS skipped FROM pages""",
)
def _(t):
    # "?p", "*" and "(?P<a>b)" are no valid patterns and count as plain text.
    patterns = ur.parse_skip_patterns(r"utm_, ?p,/de/\d+$,*,/\p{Lu}+$,(?P<a>b)")
    return t.table("pages").select("page_id", ur.matches_skip(F.col("url"), patterns).alias("skipped"))


HREF = """CASE page_id % 7 WHEN 0 THEN ' ' WHEN 1 THEN '#' WHEN 2 THEN 'MailTo:a@b.example' WHEN 3 THEN 'tel:1'
          WHEN 4 THEN ' javascript:void(0)' WHEN 5 THEN '#top' ELSE url END"""


@query(
    "navigable_href",
    f"""SELECT page_id, trim({HREF}, ' ') NOT IN ('', '#')
        AND NOT regexp_matches(lower(trim({HREF}, ' ')), '^(mailto|tel|javascript|data):') AS navigable FROM pages""",
)
def _(t):
    return t.table("pages").select("page_id", ur.is_navigable_href(F.expr(HREF)).alias("navigable"))


@query(
    "truncate_display",
    "SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END AS shown FROM documents",
)
def _(t):
    return t.table("documents").select("doc_id", truncate_display(F.col("text"), DISPLAY_URL_LENGTH).alias("shown"))


@query(
    "safe_run_name",
    """SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[<>:"/\\\\|?*]', '_', 'g') AS name FROM pages""",
)
def _(t):
    host = F.regexp_replace("url", "^https?://", "")
    return t.table("pages").select("page_id", fl.safe_run_name(host).alias("name"))


# --- fetch log ---
@query(
    "redirect_status",
    """SELECT site_id, url, arg_min(status, seq) AS first_status, arg_max(status, seq) AS final_status
       FROM fx_fetch_log GROUP BY ALL""", "fx_fetch_log",
)
def _(t):
    return log.redirect_status(t.fetch_log().withColumnRenamed("seq", "hop"))


STREAKS = """r AS (SELECT *, row_number() OVER w AS n,
    max(CASE WHEN status NOT IN (429, 503, 403) THEN seq END) OVER w AS reset
    FROM fx_fetch_log WINDOW w AS (PARTITION BY site_id ORDER BY seq)),
  k AS (SELECT *, CAST(n - coalesce(reset, 0) AS BIGINT) AS streak FROM r),
  c AS (SELECT site_id, min(seq) AS cut FROM k WHERE streak >= 5 GROUP BY site_id)"""


@query(
    "block_streaks",
    f"""WITH {STREAKS} SELECT site_id, seq, url, status, retry_after, streak
        FROM k LEFT JOIN c USING (site_id) WHERE cut IS NULL OR seq <= cut""", "fx_fetch_log",
)
def _(t):
    return log.block_streaks(t.fetch_log())


@query(
    "retry_plan",
    """WITH a AS (SELECT *, row_number() OVER (PARTITION BY site_id, url ORDER BY seq) AS attempt
         FROM fx_fetch_log WHERE status IN (429, 503))
       SELECT site_id, seq, url, status, attempt, attempt <= 3 AS retried,
         CASE WHEN attempt <= 3 THEN least(300.0::DOUBLE, greatest(30.0::DOUBLE * power(2, attempt - 1),
           coalesce(try_cast(retry_after AS DOUBLE), 0))) END AS wait_seconds FROM a""", "fx_fetch_log",
)
def _(t):
    return log.retry_plan(t.fetch_log())


@query(
    "retry_plan_until_stop",
    f"""WITH {STREAKS}, t AS (SELECT k.* FROM k LEFT JOIN c USING (site_id) WHERE cut IS NULL OR seq <= cut),
       a AS (SELECT *, row_number() OVER (PARTITION BY site_id, url ORDER BY seq) AS attempt
         FROM t WHERE status IN (429, 503))
       SELECT site_id, seq, url, status, attempt, attempt <= 3 AND streak < 5 AS retried,
         CASE WHEN attempt <= 3 AND streak < 5 THEN least(300.0::DOUBLE, greatest(30.0::DOUBLE * power(2, attempt - 1),
           coalesce(try_cast(retry_after AS DOUBLE), 0))) END AS wait_seconds FROM a""", "fx_fetch_log",
)
def _(t):
    # Stored once: the plan looks at the log twice.
    return log.retry_plan(materialize(log.block_streaks(t.fetch_log()), "cut-log"))


@query(
    "parsable_pages",
    """SELECT page_id, url, status, content_type FROM fx_page_http
       WHERE error IS NULL AND status = 200 AND contains(lower(content_type), 'html')""", "fx_page_http",
)
def _(t):
    return filters.parsable_pages(t.view("fx_page_http")).select("page_id", "url", "status", "content_type")


# --- files and state ---
PRINT = "CAST(size AS STRING) || ':' || CAST(mtime AS STRING) || ':sig'"


@query(
    "fingerprint",
    f"""SELECT path, {PRINT} AS fingerprint,
        substr(sha256(replace(path, '/v/', '') || 'sig' || {PRINT}), 1, 12) AS tag FROM fx_files""", "fx_files",
)
def _(t):
    rows = t.view("fx_files").withColumn("fingerprint", fl.fingerprint(F.col("size"), F.col("mtime"), F.lit("sig")))
    tag = fl.file_tag(fl.relative_path(F.col("path"), "/v"), F.lit("sig"), F.col("fingerprint"))
    return rows.select("path", "fingerprint", tag.alias("tag"))


@query(
    "path_parts",
    """SELECT path, CASE WHEN contains(substr(path, 4), '/') THEN split_part(path, '/', 3) ELSE '' END AS date,
       regexp_extract(path, '[^/]*$', 0) AS filename, regexp_extract(path, '([^/]*)\\.mp4$', 1) AS stem,
       '.mp4' AS extension FROM fx_files""", "fx_files",
)
def _(t):
    parts = fl.path_parts(fl.relative_path(F.col("path"), "/v/"))
    return t.view("fx_files").select("path", *[c.alias(n) for n, c in parts.items()])


def _printed(t):
    return t.view("fx_files").select(
        "path", fl.fingerprint(F.col("size"), F.col("mtime"), F.lit("sig")).alias("fingerprint")
    )


@query(
    "pending_files",
    f"""WITH f AS (SELECT path, {PRINT} AS fingerprint FROM fx_files)
        SELECT path, fingerprint FROM f WHERE NOT EXISTS (SELECT 1 FROM fx_state s
          WHERE s.path = f.path AND s.fingerprint = f.fingerprint AND s.processing_status <> 'Failed')""",
    "fx_files fx_state",
)
def _(t):
    return st.pending_files(_printed(t), t.view("fx_state"), retry_failed=True).select("path", "fingerprint")


UPDATE = """u AS (SELECT path, 'new' AS fingerprint, 'Success' AS processing_status,
  CAST(CASE WHEN size % 2 = 0 THEN 1000000 ELSE 0 END + size AS BIGINT) AS updated_at FROM fx_files)"""


@query(
    "state_upsert",
    f"""WITH {UPDATE}, a AS (SELECT * FROM fx_state UNION ALL SELECT * FROM u)
        SELECT path, fingerprint, processing_status, updated_at FROM a
        QUALIFY row_number() OVER (PARTITION BY path ORDER BY updated_at DESC) = 1""",
    "fx_files fx_state",
)
def _(t):
    updates = t.view("fx_files").selectExpr(
        "path", "'new' AS fingerprint", "'Success' AS processing_status",
        "CAST(CASE WHEN size % 2 = 0 THEN 1000000 ELSE 0 END + size AS BIGINT) AS updated_at",
    )
    return st.state_upsert(t.view("fx_state"), updates)
