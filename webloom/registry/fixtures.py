"""Inputs of the named queries, derived from the driver tables.

``SHARED`` views are plain projections whose SQL runs unchanged in Spark and DuckDB. The
ordered ones (``fx_fetch_log``, ``fx_frames``, ``fx_clips``) number events
per user: DuckDB does it with one window, Spark with split windows, as one user may own a
large share of all events, and stores them as the tables the operators expect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from webloom.operators.split_windows import row_numbers
from webloom.session import new_folder

# Stored pages with the metadata of their responses; a plain projection, so that rows keep their files.
PAGE_HTTP = [
    "page_id", "url", "html",
    "CASE CAST(page_id % 10 AS INT) WHEN 3 THEN 404 WHEN 5 THEN 503 ELSE 200 END AS status",
    "CASE CAST(page_id % 10 AS INT) WHEN 3 THEN 404 WHEN 5 THEN 503 WHEN 7 THEN 301 ELSE 200 END AS first_status",
    "CASE WHEN page_id % 8 = 6 THEN 'application/pdf' ELSE 'text/html; charset=utf-8' END AS content_type",
    "CASE WHEN page_id % 6 = 1 THEN 'NoIndex, nofollow' WHEN page_id % 6 = 2 THEN 'nofollow' ELSE '' END AS x_robots_tag",
    "CASE WHEN page_id % 29 = 11 THEN 'timeout' ELSE NULL END AS error",
]

# A stored page as a page of one of three sites: its own title, menu, text and footer, with metadata added to its head,
# a block of links behind its heading, and a content root, menu element and overlay that differ from page to page.
_NUMBER = "CAST(page_id AS STRING)"
_CHILD = "CAST(2 * CAST((page_id - page_id % 3) / 3 AS BIGINT) + {} AS STRING)"
_HEAD = f"""'<meta name="Description" content=" d' || {_NUMBER} || ' "><meta name="robots" content="'
       || CASE WHEN page_id % 4 = 1 THEN 'NOINDEX' ELSE 'index' END || '"><link rel="canonical" href="/c/' || {_NUMBER} || '">'
       || CASE WHEN page_id % 5 = 2 THEN '<meta name="GoogleBot" content="NoFollow">' WHEN page_id % 5 = 4 THEN '<meta name="googlebot" content="all">' ELSE '' END
       || CASE WHEN page_id % 7 = 3 THEN '<meta property="og:title" content="Shared ' || {_NUMBER} || '"><meta property="og:description" content="about">' ELSE '' END
       || '</head>'"""
_LINKS = f"""'</h1>' || CASE WHEN page_id % 10 < 7 THEN '<a href="/pricing">Pricing</a>' ELSE '' END
       || CASE WHEN page_id % 3 = 1 THEN '<div aria-modal="true"><a href="/consent">Consent</a></div>' ELSE '' END
       || '<a href="/p/' || {_CHILD.format(1)} || '">left</a><a href="/p/' || {_CHILD.format(2)} || '#top">right  side</a>'
       || '<a href="/p/0"><img src="i.png" alt="home  icon"></a><a href="/f.PDF">file</a><a href="https://other.example/">x</a>'
       || '<a href="mailto:a@b.example">m</a><a href="/p/0"><img src="i.png" alt="home icon"></a>'"""
_ROOTS = (("<main>", "</main>"), ('<div id="content">', "</div>"), ("<article>", "</article>"), ("", ""))


def _by_root(place: int) -> str:
    return "CASE CAST(page_id % 4 AS INT) " + " ".join(f"WHEN {n} THEN '{tags[place]}'" for n, tags in enumerate(_ROOTS)) + " END"


SITE_HTML = f"""replace(replace(replace(replace(replace(replace(html, '</head>', {_HEAD}), '</article>', {_by_root(1)}),
       '<article>', {_by_root(0)}), '</h1>', {_LINKS}),
       '<nav><ul>', CASE WHEN page_id % 5 = 0 THEN '<div class="navbar"><ul>' ELSE '<nav><ul>' END || '<li><a href="/menu">Menu</a></li>'),
       '</ul></nav>', CASE WHEN page_id % 5 = 0 THEN '</ul></div>' ELSE '</ul></nav>' END)"""

SHARED = {
    "fx_urls": """
SELECT page_id AS row_id,
       CASE WHEN page_id % 13 = 5 THEN NULL
            WHEN page_id % 13 = 7 THEN '   '
            WHEN page_id % 5 = 1 THEN regexp_replace(url, '^https?://', '')
            WHEN page_id % 5 = 2 THEN '  ' || url || ' '
            ELSE url END AS url
FROM pages""",
    "fx_queries": f"""
SELECT doc_id AS row_id, lang, n_chars,
       CASE WHEN doc_id % 17 = 3 THEN NULL
            WHEN doc_id % 4 = 1 THEN substr(text, 1, 9) || '{chr(0x200c)}' || substr(text, 10)
            WHEN doc_id % 4 = 2 THEN '{chr(0xa0)}' || substr(text, 1, 6) || '   ' || substr(text, 7)
            ELSE text END AS query
FROM documents""",
    "fx_titles": """
SELECT p_partkey AS row_id,
       CASE WHEN p_partkey % 19 = 2 THEN '  '
            WHEN p_partkey % 19 = 3 THEN '???'
            WHEN p_partkey % 19 = 4 THEN 'Same: title?'
            ELSE ' ' || p_name || ' / ' || p_brand || ' ' END AS title
FROM part""",
    "fx_replies": """
SELECT p_partkey AS row_id,
       CASE CAST(p_partkey % 8 AS INT)
         WHEN 0 THEN '{"response":" r ' || p_name || ' ","text":"no"}'
         WHEN 1 THEN '{"text":"t ' || p_name || '"}'
         WHEN 2 THEN '{"content":"c ' || p_name || ' "}'
         WHEN 3 THEN '{"message":"m ' || p_name || '"}'
         WHEN 4 THEN '{"choices":[{"message":{"content":" k ' || p_name || ' "}}]}'
         WHEN 5 THEN '{"response":""}'
         WHEN 6 THEN '<html>502 Bad Gateway ' || p_name || '</html>'
         ELSE NULL END AS reply_json
FROM part""",
    "fx_page_http": f"""
SELECT {", ".join(PAGE_HTTP)}
FROM pages""",
    "fx_site": f"""
SELECT page_id, 'site' || CAST(page_id % 3 AS STRING) || '.example' AS site,
       'https://site' || CAST(page_id % 3 AS STRING) || '.example/p/' || CAST(CAST((page_id - page_id % 3) / 3 AS BIGINT) AS STRING) AS url,
       CASE CAST(page_id % 10 AS INT) WHEN 9 THEN 404 ELSE 200 END AS status,
       CASE CAST(page_id % 10 AS INT) WHEN 9 THEN 404 WHEN 8 THEN 301 ELSE 200 END AS first_status,
       CASE WHEN page_id % 16 = 15 THEN 'image/png' ELSE 'text/html' END AS content_type,
       CASE WHEN page_id % 6 = 2 THEN 'NoIndex, nofollow' WHEN page_id % 6 = 3 THEN 'nofollow' ELSE NULL END AS x_robots_tag,
       CASE WHEN page_id % 47 = 40 THEN 'timeout' ELSE NULL END AS error,
       {SITE_HTML} AS html
FROM pages""",
    "fx_inspection": """
SELECT page_id AS row_id, url,
       CASE WHEN page_id % 11 = 4 THEN NULL ELSE
       '{"inspectionResult":{"inspectionResultLink":"https://console.example/' || CAST(page_id AS STRING) || '","indexStatusResult":{"verdict":"'
       || CASE WHEN page_id % 5 = 2 THEN 'NEUTRAL' ELSE 'PASS' END || '","robotsTxtState":"'
       || CASE WHEN page_id % 7 = 3 THEN 'DISALLOWED' ELSE 'ALLOWED' END || '"'
       || CASE WHEN page_id % 3 = 0 THEN '' ELSE ',"pageFetchState":"' || CASE WHEN page_id % 9 = 8 THEN 'SOFT_404' ELSE 'SUCCESSFUL' END || '"' END
       || ',"lastCrawlTime":"2024-01-0' || CAST(1 + page_id % 9 AS STRING) || 'T00:00:00Z","crawledAs":"MOBILE"}}}' END AS response_json,
       CASE WHEN page_id % 11 = 4 THEN 'quota exceeded' ELSE NULL END AS api_error
FROM pages""",
    "fx_files": """
SELECT '/v/' || CASE WHEN page_id % 6 = 0 THEN '' ELSE '2024010' || CAST(1 + page_id % 5 AS STRING) || '/' END || 'clip' || CAST(page_id AS STRING) || '.mp4' AS path,
       CAST(1000 + page_id AS BIGINT) AS size, CAST(1700000000000000 + page_id * 10 AS BIGINT) AS mtime
FROM pages""",
    "fx_state": """
SELECT '/v/' || CASE WHEN page_id % 6 = 0 THEN '' ELSE '2024010' || CAST(1 + page_id % 5 AS STRING) || '/' END || 'clip' || CAST(page_id AS STRING) || '.mp4' AS path,
       CAST(1000 + page_id + CASE WHEN page_id % 7 = 2 THEN 1 ELSE 0 END AS STRING) || ':' || CAST(1700000000000000 + page_id * 10 AS STRING) || ':sig' AS fingerprint,
       CASE WHEN page_id % 8 = 3 THEN 'Failed' ELSE 'Success' END AS processing_status,
       CAST(page_id * 7 AS BIGINT) AS updated_at
FROM pages WHERE page_id % 4 <> 1""",
}

# How one event looks as an attempt or a frame; runs in both engines.
_ATTEMPT = [
    "'https://s' || CAST(user_id AS STRING) || '.example/' || CAST(event_id % 4 AS STRING) AS url",
    "CASE event_type WHEN 'error' THEN 503 WHEN 'signup' THEN 429 WHEN 'click' THEN 403 ELSE 200 END AS status",
    "CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 400 AS STRING) WHEN event_id % 3 = 1 THEN 'soon' END AS retry_after",
]
_FRAME = [
    "CASE WHEN user_id % 29 = 7 THEN CAST(0.0 AS DOUBLE) ELSE CAST(16.0 AS DOUBLE) END AS fps",
    "CASE WHEN user_id % 13 = 5 AND event_id % 40 < 20 THEN 640 ELSE 320 END AS width",
    "240 AS height",
    "event_id % 31 <> 0 AS decoded",
    # A tenth of the clips are quiet.
    "event_type <> 'error' AND user_id % 10 <> 0 AS boxed",
    "CAST(event_id % 4 * 15 AS INT) AS x",
    "CAST(event_id % 3 * 10 AS INT) AS y",
    "20 AS w",
    "20 AS h",
    "CAST(value AS DOUBLE) / 2000 AS score",
    "(event_type = 'purchase' AND event_id % 7 = 0) AS uncertain",
    "user_id % 17 = 4 AS view_matches",
]
_CLIP = [
    "'/v/' || CASE WHEN clip_id % 6 = 0 THEN '' ELSE '2024010' || CAST(1 + clip_id % 5 AS STRING) || '/' END"
    " || 'clip' || CAST(clip_id AS STRING) || '.mp4' AS path",
    "'camera' || CAST(clip_id % 3 AS STRING) AS camera_profile",
    "CASE WHEN clip_id % 29 = 7 THEN CAST(0.0 AS DOUBLE) ELSE CAST(16.0 AS DOUBLE) END AS fps",
    "frames",
    "CAST(frames + CASE WHEN clip_id % 4 = 1 THEN 9 ELSE 0 END AS BIGINT) AS expected_frames",
]
_DETECTION = [
    "user_id AS clip_id",
    "event_id AS frame_index",
    "CAST(k AS INT) AS k",
    "CAST(20 + (event_id * (k + 3)) % 90 AS DOUBLE) AS area",
    "CAST(event_id % 50 AS INT) AS x",
    "CAST(k * 10 AS INT) AS y",
    "12 AS w",
    "9 AS h",
    "CAST(100000 AS BIGINT) AS frame_size",
]

PROFILES = {f"camera{n}": {"width": 320, "height": 240, "rectangle": [0, 0, 320, 240]} for n in range(3)}

ORDERED = {
    "fx_fetch_log": f"""
SELECT user_id AS site_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS seq,
       {", ".join(_ATTEMPT)}
FROM events""",
    "fx_frames": f"""
SELECT user_id AS clip_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS frame_index,
       {", ".join(_FRAME)}
FROM events""",
    "fx_clips": f"""
SELECT clip_id, {", ".join(_CLIP)}
FROM (SELECT user_id AS clip_id, count(*) AS frames FROM events GROUP BY user_id
      UNION ALL SELECT s_suppkey + 1000000, 0 FROM supplier) c""",
    "fx_detections": f"""
SELECT {", ".join(_DETECTION)}
FROM (SELECT *, unnest(range(0, CAST(event_id % 3 + 1 AS BIGINT))) AS k FROM events) e""",
}


def sql_views(*names: str) -> str:
    """The ``WITH`` clause that gives a check its inputs."""
    texts = {**SHARED, **ORDERED}
    return "WITH RECURSIVE " + ",\n".join(f"{name} AS ({texts[name]})" for name in names)


# Written fixtures by application, folder and name: several queries read the same ones.
_written: dict[tuple[str, str, str], tuple[str, StructType]] = {}


class Tables:
    """Driver tables of one scale factor and the fixtures over them, in Spark."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def view(self, name: str) -> DataFrame:
        """A shared fixture from its SQL text."""
        text = SHARED[name]
        source = text.rsplit("FROM ", 1)[1].split()[0]
        alias = f"webloom_{source}"
        self.table(source).createOrReplaceTempView(alias)
        before, after = text.rsplit(f"FROM {source}", 1)
        return self.spark.sql(f"{before}FROM {alias}{after}")

    def stored_pages(self) -> DataFrame:
        """The rows of ``fx_page_http``, straight from their files."""
        return self.table("pages").selectExpr(*PAGE_HTTP)

    def _numbered_events(self) -> DataFrame:
        events = self.table("events").drop("ts", "props")
        return row_numbers(events, ["user_id"], "event_id", "n")

    def _once(self, name: str, build) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _written:
            rows, path = build(), new_folder(self.spark, name)
            rows.write.parquet(path)
            _written[key] = path, rows.schema
        path, schema = _written[key]
        return self.spark.read.schema(schema).parquet(path)

    def fetch_log(self) -> DataFrame:
        return self._once("fetch-log", lambda: self._numbered_events().selectExpr("user_id AS site_id", "n AS seq", *_ATTEMPT))

    def frames(self) -> DataFrame:
        return self._once("frames", self._frames)

    def _frames(self) -> DataFrame:
        rows = self._numbered_events().selectExpr(
            "user_id AS clip_id", "n - 1 AS frame_index", *_FRAME
        )
        box = F.array(F.struct("x", "y", "w", "h"))
        boxes = F.when(F.col("boxed"), box).otherwise(F.slice(box, 1, 0)).alias("boxes")
        return rows.select(
            "clip_id", "frame_index", "fps", "width", "height", "decoded", boxes, "score", "uncertain", "view_matches"
        )

    def clips(self) -> DataFrame:
        seen = self.table("events").groupBy(F.col("user_id").alias("clip_id")).agg(
            F.count(F.lit(1)).alias("frames")
        )
        empty = self.table("supplier").select((F.col("s_suppkey") + 1000000).alias("clip_id"), F.lit(0).alias("frames"))
        return seen.unionByName(empty).selectExpr("clip_id", *_CLIP)

    def detections(self) -> DataFrame:
        k = F.explode(F.sequence(F.lit(0), (F.col("event_id") % 3).cast("int")))
        return self.table("events").select("user_id", "event_id", k.alias("k")).selectExpr(*_DETECTION)
