"""Queries over stored pages, the link graph, inspections and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.functions.robots import final_status, has_nofollow, has_noindex, robots_text
from webloom.operators import inspection as ins, links as ln, pages as pg
from webloom.operators.crawl import crawl_bfs
from webloom.operators.filters import is_parsable
from webloom.plans.content_extract import content_extract, extract_counts
from webloom.plans.inspection import inspect_urls
from webloom.plans.site_audit import parse_snapshot, site_audit
from webloom.registry.catalog import collapsed, query, stripped, unescaped, without_tags
from webloom.registry.url_queries import HOST
from webloom.session import materialize, spread


def _title(tag: str) -> str:
    return collapsed(unescaped(f"regexp_extract(html, '<{tag}>(.*?)</{tag}>', 1, 's')"))


# --- stored pages ---
@query(
    "page_metadata",
    f"""SELECT page_id, {_title('title')} AS title, '' AS description, '' AS canonical, '' AS meta_robots,
        {_title('h1')} AS h1 FROM pages""",
)
def _(t):
    return pg.page_metadata(spread(t.table("pages")), ("page_id",))


def _attr(pattern: str) -> str:
    return stripped(unescaped(f"regexp_extract(html, '{pattern}', 1, 's')"))


@query(
    "page_metadata_exact",
    f"""SELECT page_id, {_attr("<title>(.*?)</title>")} AS title, '' AS description,
        {_attr('rel="canonical" href="([^"]*)"')} AS canonical, {_attr('name="robots" content="([^"]*)"')} AS meta_robots,
        {_attr('<h1>(.*?)</h1>')} AS h1 FROM fx_site""", "fx_site",
)
def _(t):
    return pg.page_metadata(spread(t.view("fx_site")), ("page_id",), exact=True)


OG_TITLE = f"CASE WHEN page_id % 7 = 3 THEN 'Shared ' || page_id ELSE {_title('title')} END"
OG_DESCRIPTION = "CASE WHEN page_id % 2 = 0 THEN 'd' || page_id WHEN page_id % 7 = 3 THEN 'about' ELSE '' END"


@query("page_metadata_og", f"SELECT page_id, {OG_TITLE} AS title, {OG_DESCRIPTION} AS description FROM fx_site", "fx_site")
def _(t):
    # Without the plain description on every second page, the shared one stands in.
    plain = F.expr("if(page_id % 2 = 1, replace(html, '<meta name=\"Description\"', '<meta name=\"none\"'), html)")
    return pg.page_metadata_og(spread(t.view("fx_site")).withColumn("html", plain), ("page_id",))


ARTICLE = without_tags("regexp_extract(html, '<article>(.*?)(</article>|$)', 1, 's')")


@query("main_text", f"SELECT page_id, {ARTICLE} AS body_content FROM pages")
def _(t):
    return pg.main_text(spread(t.table("pages")), ("page_id",))


@query(
    "robots_directives",
    """SELECT page_id, lower(regexp_extract(html, 'name="robots" content="([^"]*)"', 1)) AS live_meta_robots,
       lower(regexp_extract(html, '(?i)name="googlebot" content="([^"]*)"', 1)) AS live_meta_googlebot FROM fx_site""", "fx_site",
)
def _(t):
    return pg.robots_directives(spread(t.view("fx_site")), ("page_id",))


NAV = """n AS (SELECT page_id, url, unnest(regexp_extract_all(
  regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'), '<a href="[^"]*">[^<]*</a>')) AS a FROM pages)"""


@query(
    "discover_links",
    f"""WITH {NAV} SELECT DISTINCT page_id, url AS source, regexp_extract(url, '^https?://', 0) || {HOST.format('url')}
        || {unescaped("regexp_extract(a, 'href=.([^\"]*)\"', 1)")} AS destination FROM n""",
)
def _(t):
    return ln.discover_links(spread(t.table("pages")), keep=("page_id",))


@query(
    "excluded_links",
    f"""WITH {NAV} SELECT page_id, url AS source, {unescaped("regexp_extract(a, 'href=.([^\"]*)\"', 1)")} AS href,
        {collapsed(unescaped("regexp_extract(a, '>([^<]*)<', 1)"))} AS anchor_text FROM n""",
)
def _(t):
    return ln.excluded_links(spread(t.table("pages")), keep=("page_id",))


@query(
    "excluded_links_legacy",
    f"""WITH n AS (SELECT page_id, url, unnest(regexp_extract_all(regexp_extract(html, '(<nav>|<div class="navbar">)<ul>(.*?)</ul>', 2, 's'),
          '<a href="[^"]*">[^<]*</a>')) AS a FROM fx_site)
        SELECT page_id, url AS source, {unescaped("regexp_extract(a, 'href=.([^\"]*)\"', 1)")} AS href,
        {collapsed(unescaped("regexp_extract(a, '>([^<]*)<', 1)"))} AS anchor_text FROM n""", "fx_site",
)
def _(t):
    return ln.excluded_links(spread(t.view("fx_site")), keep=("page_id",), legacy_rule=True)


# What stands in a page's content root; an overlay holds the only inner element of its kind.
CONTENT = """CASE CAST(page_id % 4 AS INT) WHEN 0 THEN regexp_extract(html, '<main>(.*?)(</main>|$)', 1, 's')
    WHEN 1 THEN regexp_extract(html, '<div id="content">((<div aria-modal.*?</div>|.)*?)(</div>|$)', 1, 's')
    WHEN 2 THEN regexp_extract(html, '<article>(.*?)(</article>|$)', 1, 's') ELSE regexp_extract(html, '</h1>(.*)$', 1, 's') END"""


@query(
    "content_roots",
    f"""SELECT page_id, url, CASE CAST(page_id % 4 AS INT) WHEN 0 THEN 'main' WHEN 1 THEN 'named' WHEN 2 THEN 'article' ELSE 'after_h1' END AS root_kind,
       len(regexp_extract_all(html, '<a href=')) AS links, len(regexp_extract_all({CONTENT}, '<a href=')) AS root_links FROM fx_site""", "fx_site",
)
def _(t):
    return ln.content_roots(spread(t.view("fx_site")), keep=("page_id",))


# --- one site ---
PARSED = "error IS NULL AND status = 200 AND contains(content_type, 'html')"
# Anchors of the content, resolved; only root-relative links are internal here.
def _anchors(condition: str) -> str:
    return f"""a AS (SELECT site, page_id, url AS source, unnest(regexp_extract_all(
    regexp_replace({CONTENT}, '<div aria-modal.*?</div>', ''), '<a href="/[^"]*">.*?</a>')) AS a FROM fx_site WHERE {condition})"""


ANCHOR_TEXT = collapsed(
    "CASE WHEN contains(a, '<img') THEN regexp_extract(a, 'alt=.([^\"]*)\"', 1) ELSE regexp_extract(a, '>([^<]*)<', 1) END"
)
LINKS = f"""l AS (SELECT DISTINCT site, source, 'https://' || site || regexp_extract(a, 'href="([^"#]*)', 1) AS destination,
    {ANCHOR_TEXT} AS anchor_text FROM a WHERE NOT contains(a, '.PDF'))"""
SITE_LINKS = f"{_anchors(PARSED)}, {LINKS}"


@query("content_links", f"WITH {SITE_LINKS} SELECT site, source, destination, anchor_text FROM l", "fx_site")
def _(t):
    return _content_links(t)


def _content_links(t):
    return ln.content_links(spread(t.view("fx_site").filter(is_parsable())), keep=("site",))


def _page_totals(t):
    return t.view("fx_site").filter(is_parsable()).groupBy("site").agg(F.count(F.lit(1)).alias("pages"))


def _sitewide(pages: str) -> str:
    return f"""p AS (SELECT site, count(*) AS n FROM {pages} GROUP BY site),
      k AS (SELECT l.site, destination, anchor_text FROM l JOIN p USING (site) GROUP BY ALL
            HAVING any_value(n) >= 3 AND count(DISTINCT source) >= greatest(3, ceil(any_value(n) * 0.6)))"""


@query(
    "boilerplate_filter",
    f"""WITH {SITE_LINKS}, ok AS (SELECT * FROM fx_site WHERE {PARSED}), {_sitewide('ok')}
        SELECT site, source, destination, anchor_text FROM l WHERE NOT EXISTS (SELECT 1 FROM k
          WHERE k.site = l.site AND k.destination = l.destination AND k.anchor_text = l.anchor_text)""", "fx_site",
)
def _(t):
    # Used twice: the links are written once instead of parsing every page twice.
    return ln.boilerplate_filter(materialize(_content_links(t), "links"), _page_totals(t))


def _statuses(t):
    return t.view("fx_site").select("site", "url", F.col("first_status").cast("string").alias("status_code"))


@query(
    "link_status",
    f"""WITH {SITE_LINKS} SELECT l.site, source, destination, anchor_text,
        coalesce(CAST(first_status AS STRING), 'Not checked') AS status_code
        FROM l LEFT JOIN fx_site s ON s.site = l.site AND s.url = l.destination""", "fx_site",
)
def _(t):
    return ln.link_status(_content_links(t), _statuses(t))


@query(
    "unresolved_links",
    f"""WITH {SITE_LINKS} SELECT DISTINCT site, destination FROM l
        WHERE destination NOT IN (SELECT url FROM fx_site)""", "fx_site",
)
def _(t):
    return ln.unresolved_links(_content_links(t), _statuses(t))


EDGES = f"""h AS (SELECT site, url, unnest(regexp_extract_all(html, '<a href="(/[^"#]*)', 1)) AS href
    FROM fx_site WHERE {PARSED}),
  e AS (SELECT DISTINCT site, url, 'https://' || site || {unescaped('href')} AS dst FROM h WHERE NOT ends_with(href, '.PDF')),
  b AS (SELECT DISTINCT site, 'https://' || site || '/p/0' AS url, 0 AS depth FROM fx_site
        UNION SELECT e.site, e.dst, b.depth + 1 FROM b JOIN e ON e.site = b.site AND e.url = b.url WHERE b.depth < 60),
  v AS (SELECT site, url, min(depth) AS depth FROM b GROUP BY ALL)"""


def _starts(t):
    return t.view("fx_site").select("site").distinct().withColumn(
        "start_url", F.concat(F.lit("HTTPS://"), "site", F.lit("/p/0#start"))
    )


@query("crawl_bfs", f"WITH {EDGES} SELECT site, url, depth FROM v", "fx_site")
def _(t):
    pages = materialize(parse_snapshot(spread(t.view("fx_site"))), "parsed-pages")
    starts = _starts(t).select("site", F.concat(F.lit("https://"), "site", F.lit("/p/0")).alias("url"))
    return crawl_bfs(starts, pages.filter("parsed").select("site", "url", "targets"))


def _audit(t):
    return site_audit(spread(t.view("fx_site")), _starts(t))


def _meta(column: str, expression: str) -> str:
    return f"CASE WHEN {PARSED} THEN {expression} ELSE '' END AS {column}"


STATUS = "coalesce('Error: ' || error, CAST(first_status AS STRING), 'Not checked')"
AUDIT_PAGES = f"""WITH {EDGES} SELECT v.site, v.url,
  {_meta('title', _title('title'))},
  {_meta('description', _attr('name="Description" content="([^"]*)"'))},
  {_meta('canonical', _attr('rel="canonical" href="([^"]*)"'))},
  {_meta('meta_robots', _attr('name="robots" content="([^"]*)"'))},
  {_meta('h1', _title('h1'))}, {STATUS} AS status_code, depth
  FROM v LEFT JOIN fx_site s ON s.site = v.site AND s.url = v.url"""


@query("crawl_report", AUDIT_PAGES.replace(", depth\n", "\n"), "fx_site")
def _(t):
    return _audit(t).pages.drop("depth")


@query("site_audit_pages", AUDIT_PAGES, "fx_site")
def site_audit_pages(t):
    return _audit(t).pages


@query(
    "site_audit_links",
    f"""WITH {EDGES}, {_anchors(PARSED + ' AND url IN (SELECT url FROM v)')}, {LINKS},
  ok AS (SELECT * FROM fx_site WHERE {PARSED} AND url IN (SELECT url FROM v)), {_sitewide('ok')},
  s AS (SELECT * FROM fx_site WHERE url IN (SELECT url FROM v))
  SELECT l.site, source, l.destination, l.anchor_text, {STATUS} AS status_code
  FROM l LEFT JOIN s ON s.site = l.site AND s.url = l.destination
  WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.site = l.site AND k.destination = l.destination
    AND k.anchor_text = l.anchor_text)""", "fx_site",
)
def site_audit_links(t):
    return _audit(t).links


# --- content of a URL list ---
TRIMMED = stripped("u.url")
LISTED = f"""w AS (SELECT row_id, CASE WHEN regexp_matches({TRIMMED}, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN {TRIMMED}
    ELSE 'https://' || {TRIMMED} END AS page_url FROM fx_urls u WHERE coalesce({TRIMMED}, '') <> ''),
  c AS (SELECT row_id, page_url, coalesce({_title('title')}, '') AS title, '' AS description,
    coalesce({ARTICLE}, '') AS body_content, p.url IS NOT NULL AS found FROM w LEFT JOIN (SELECT * FROM fx_page_http WHERE {PARSED}) p ON p.url = w.page_url)"""


@query(
    "content_extract",
    f"WITH {LISTED} SELECT row_id, page_url, title, description, body_content, found FROM c", "fx_urls fx_page_http",
)
def _(t):
    return content_extract(t.view("fx_urls"), t.stored_pages(), keep=("row_id",))


@query(
    "content_extract_counts",
    f"""WITH {LISTED} SELECT count(*) FILTER (found) AS successful,
        count(*) FILTER (NOT found) AS failed FROM c""", "fx_urls fx_page_http",
)
def _(t):
    return extract_counts(content_extract(t.view("fx_urls"), t.stored_pages(), keep=("row_id",)))


# --- inspection ---
def _field(name: str) -> str:
    return f"json_extract_string(response_json, '$.inspectionResult.indexStatusResult.{name}')"


FLAT = f"""f AS (SELECT row_id, url, CASE WHEN api_error IS NOT NULL THEN 'ERROR' ELSE {_field('verdict')} END AS gsc_verdict,
    {_field('coverageState')} AS coverage_state, {_field('indexingState')} AS indexing_state,
    {_field('lastCrawlTime')} AS last_crawl_time, {_field('pageFetchState')} AS page_fetch_state,
    {_field('robotsTxtState')} AS robots_txt_state, {_field('crawledAs')} AS crawled_as,
    {_field('googleCanonical')} AS google_canonical, {_field('userCanonical')} AS user_canonical,
    json_extract_string(response_json, '$.inspectionResult.inspectionResultLink') AS inspection_link,
    api_error AS gsc_error FROM fx_inspection)"""
ROBOTS = """lower(regexp_extract(html, 'name="robots" content="([^"]*)"', 1))"""
GOOGLEBOT = """lower(regexp_extract(html, '(?i)name="googlebot" content="([^"]*)"', 1))"""
FLAGS = f"({ROBOTS} || ' ' || {GOOGLEBOT} || ' ' || coalesce(lower(x_robots_tag), ''))"
LIVE = f"""g AS (SELECT page_id AS row_id, CASE WHEN error IS NULL THEN status END AS live_http_status,
    CASE WHEN error IS NULL THEN url END AS live_final_url,
    error IS NULL AND status = 200 AND NOT contains({FLAGS}, 'noindex') AS live_available,
    CASE WHEN error IS NULL THEN contains({FLAGS}, 'noindex') END AS live_noindex,
    CASE WHEN error IS NULL THEN contains({FLAGS}, 'nofollow') END AS live_nofollow,
    CASE WHEN error IS NULL THEN {ROBOTS} END AS live_meta_robots,
    CASE WHEN error IS NULL THEN {GOOGLEBOT} END AS live_meta_googlebot,
    CASE WHEN error IS NULL THEN coalesce(lower(x_robots_tag), '') END AS live_x_robots_tag,
    error AS live_error FROM fx_site)"""
VERDICT = """CASE WHEN coalesce(gsc_error, '') <> '' THEN 'GSC_API_ERROR' WHEN coalesce(live_error, '') <> '' THEN 'LIVE_CHECK_ERROR'
    WHEN live_http_status IS DISTINCT FROM 200 THEN 'URL_NOT_AVAILABLE_LIVE' WHEN live_noindex THEN 'NOINDEX_LIVE'
    WHEN robots_txt_state = 'DISALLOWED' THEN 'BLOCKED_BY_ROBOTS_TXT_GSC'
    WHEN page_fetch_state <> 'SUCCESSFUL' THEN 'PAGE_FETCH_PROBLEM_GSC'
    WHEN gsc_verdict IS DISTINCT FROM 'PASS' THEN 'GSC_INDEXING_ISSUE' ELSE 'OK' END AS final_status"""


@query("inspection_flatten", f"WITH {FLAT} SELECT * FROM f", "fx_inspection")
def _(t):
    return ins.inspection_flatten(t.view("fx_inspection"))


@query(
    "inspection_flatten_short",
    f"""WITH {FLAT} SELECT row_id, url, coalesce(gsc_verdict, 'ERROR') AS status, coverage_state, last_crawl_time,
        page_fetch_state, robots_txt_state, gsc_error AS error FROM f""", "fx_inspection",
)
def _(t):
    return ins.inspection_flatten_short(t.view("fx_inspection"))


def _fetched(t):
    return spread(t.view("fx_site")).select(
        F.col("page_id").alias("row_id"), F.col("url").alias("final_url"), "status", "html", "x_robots_tag", "error"
    )


@query(
    "robots_flags",
    f"""SELECT page_id, contains({FLAGS}, 'noindex') AS noindex, contains({FLAGS}, 'nofollow') AS nofollow,
        status = 200 AND NOT contains({FLAGS}, 'noindex') AS available FROM fx_site""", "fx_site",
)
def _(t):
    rows = pg.robots_directives(spread(t.view("fx_site")), ("page_id", "status", "x_robots_tag"))
    text = robots_text(F.col("live_meta_robots"), F.col("live_meta_googlebot"), F.col("x_robots_tag"))
    return rows.withColumn("flags", text).select(
        "page_id", has_noindex(F.col("flags")).alias("noindex"), has_nofollow(F.col("flags")).alias("nofollow"),
        ((F.col("status") == 200) & ~has_noindex(F.col("flags"))).alias("available"),
    )


@query("final_status", f"WITH {FLAT}, {LIVE} SELECT row_id, {VERDICT} FROM f JOIN g USING (row_id)", "fx_inspection fx_site")
def _(t):
    joined = ins.inspection_flatten(t.view("fx_inspection")).join(ins.live_checks(_fetched(t)), "row_id")
    return joined.select("row_id", final_status().alias("final_status"))


@query("inspection_report", f"WITH {FLAT}, {LIVE} SELECT *, {VERDICT} FROM f JOIN g USING (row_id)", "fx_inspection fx_site")
def _(t):
    return inspect_urls(t.view("fx_inspection"), _fetched(t))
