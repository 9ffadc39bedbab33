import pytest

from webloom.functions.html import names_navigation, names_navigation_legacy, read_page
from webloom.operators import links as ln, pages as pg

BASE = "https://h.example/dir/page"


def links(html, **options):
    return {l["href"]: l for l in read_page(BASE, html, **options)["links"]}


def test_head_facts():
    facts = read_page(BASE, """<html><head><title> A <b>x</b>&amp;y</title><meta NAME=Description content=" d ">
      <meta property="og:title" content="O"><link rel="alternate canonical" href=" /c "></head>
      <body><h1>One<i>two</i><!-- c -->three</h1><h1>later</h1></body></html>""")
    assert facts["title"] == "A x &y"
    assert facts["h1"] == "One two three"
    assert facts["metas"][0] == {"name": "Description", "property": None, "content": " d "}
    assert facts["rel_links"] == [{"rel": "alternate canonical", "href": " /c "}]
    assert facts["parse_error"] is None


def test_unclosed_elements_and_scripts():
    facts = read_page(BASE, '<body><p><b>a<br><p>b<script>var x="</p><a href=1>";</script><ul><li>c<li>d</ul>')
    assert facts["main_text"] == "a b c d"
    assert facts["links"] == []


def test_main_text_prefers_main_then_article_and_drops_layout():
    assert read_page(BASE, "<body>x<article>a</article><main>m<nav>n</nav><div class='box modal'>o</div></main>")["main_text"] == "m"
    assert read_page(BASE, "<body>x<article>a<form>f</form><p id=comments>c</p></article>")["main_text"] == "a"
    assert read_page(BASE, "<head><title>t</title></head><body>x<aside>a</aside> y")["main_text"] == "x y"
    assert read_page(BASE, "<body><div role=banner><main>lost</main></div>kept")["main_text"] == "kept"
    assert read_page(BASE, "")["main_text"] == ""


def test_odd_sections_and_huge_references_are_read():
    for html in ("<title>t</title><![foo[ x ]]><h1>h</h1>", f"<title>t</title><h1>h</h1><p>&#{'9' * 5000};</p>",
                 f"<title>t</title><h1>&#{'0' * 5000}104;</h1>"):
        facts = read_page(BASE, html)
        assert (facts["parse_error"], facts["title"], facts["h1"]) == (None, "t", "h")
    assert "\ufffd" in read_page(BASE, f"<body>&#{'9' * 5000};</body>")["main_text"]


def test_an_error_keeps_the_facts_before_it(monkeypatch):
    def fail(self, data):
        raise ValueError("broken")

    monkeypatch.setattr("webloom.functions.html.PageReader.handle_comment", fail)
    facts = read_page(BASE, "<title>t</title><!-- x --><h1>h</h1>")
    assert facts["parse_error"] == "ValueError: broken" and facts["title"] == "t" and facts["h1"] is None


def test_raw_h1():
    assert read_page(BASE, "<h1> A<b>B</b>  c<script>no</script></h1><h1>no</h1>")["h1_raw"] == " AB  c"


def test_anchor_text():
    found = links('<a href=1> a <b>b</b>\n c</a><a href=2><img src=x><img alt=" i  j "><img alt=k></a>'
                  '<a href=3><img alt=""><img alt=z></a><a href=4><script>s</script></a><a name=5>no</a>')
    assert [found[k]["anchor"] for k in "1234"] == ["a b c", "i j", "", ""]
    assert "5" not in found


def test_targets_are_resolved():
    found = links('<a href=" x#f ">1</a><a href="//O.example">2</a><a href="mailto:a@b">3</a><a href="http://[x">4</a>')
    assert [l["target"] for l in found.values()] == ["https://h.example/dir/x", "https://o.example/", "", ""]


@pytest.mark.parametrize("opening, excluded", [
    ("<nav>", True), ("<aside>", True), ("<dialog>", True), ("<div role=' Menu '>", True), ("<div aria-modal=TRUE>", True),
    ("<div class='x site_header'>", True), ("<div class='mobileMenuWrapper'>", False), ("<div id='top menu'>", True),
    ("<div class='primary-navigation-container'>", True), ("<div data-testid='footer'>", True),
    ("<div aria-label='Breadcrumb trail'>", True), ("<div class='headerless'>", False), ("<div name=drawer>", True),
    ("<section>", False), ("<div class='menus'>", False),
])
def test_excluded_areas(opening, excluded):
    assert links(f"<body>{opening}<p><a href=1>x</a></p>")["1"]["excluded"] is excluded


def test_overlay_needs_four_links():
    four = "".join(f"<a href={i}>x</a>" for i in range(4))
    assert all(l["excluded"] for l in links(f"<div class='md:fixed'>{four}</div>").values())
    assert all(l["excluded"] for l in links(f"<div class='absolute top-0'>{four}</div>").values())
    assert not any(l["excluded"] for l in links(f"<div class='absolute'>{four}</div>").values())
    three = links(f"<div class=sticky>{four[:-14]}<a href=y>y</a></div><a href=z>z</a>")
    assert not three["z"]["excluded"]


def test_legacy_rule_looks_at_fewer_signals():
    html = "<aside><a href=1>x</a></aside><div class='shop-menu'><a href=2>x</a></div><div aria-label=menu><a href=3>x</a></div>"
    found = links(html, legacy_rule=True)
    assert [found[k]["excluded"] for k in "123"] == [False, True, False]
    assert names_navigation_legacy("site-header-inner") and names_navigation_legacy("menu-x")
    assert not names_navigation_legacy("drawer") and names_navigation("drawer")


def kinds(spark, htmls):
    df = spark.createDataFrame([(i, BASE, h) for i, h in enumerate(htmls)], "i INT, url STRING, html STRING")
    return df


def test_content_roots_by_priority(spark):
    htmls = [
        "<div id=content><a href=/1>x</a></div><div role=main><a href=/2>x</a></div>",
        "<article><a href=/1>x</a></article><div class='a post-content'><a href=/2>x</a></div>",
        "<a href=/1>x</a><article><a href=/2>x</a></article>",
        "<body><a href=/1>x</a><h1>h<a href=/2>x</a></h1><a href=/3>x</a>",
        "<body><a href=/1>x</a>",
    ]
    rows = ln.content_roots(kinds(spark, htmls), keep=("i",)).orderBy("i").collect()
    assert [(r.root_kind, r.links, r.root_links) for r in rows] == [
        ("main", 2, 1), ("named", 2, 1), ("article", 2, 1), ("after_h1", 3, 2), ("body", 1, 1)]


def test_content_links_are_filtered_and_distinct(spark):
    html = """<main><a href="/a">t</a><a href="/a#x"> t </a><a href="/a">other</a><a href="/s.PDF">p</a><a href="#">n</a>
      <a href="https://else.example/">e</a><a href="/skip/1">s</a><div class=menu><a href="/m">m</a></div></main><a href="/out">o</a>"""
    got = ln.content_links(kinds(spark, [html]), skip_patterns=["^https://h.example/skip"]).collect()
    assert {(r.destination, r.anchor_text) for r in got} == {("https://h.example/a", "t"), ("https://h.example/a", "other")}
    assert len(got) == 2
    everything = ln.discover_links(kinds(spark, [html])).collect()
    assert {r.destination for r in everything} == {f"https://h.example/{p}" for p in ("a", "skip/1", "m", "out")}
    legacy = ln.content_links(kinds(spark, [html]), legacy_rule=True).collect()
    assert {r.destination[18:] for r in legacy} == {"a", "skip/1", "m", "out"}


def test_metadata_rules(spark):
    html = """<title> T  t </title><meta name=DESCRIPTION content=" d "><meta name=robots content="NoIndex">
      <meta name=robots content=second><link rel=xcanonicaly href=" /c "><h1> A  b </h1><meta property=og:title content="">
      <meta property=og:description content=" og  d "><meta name=GoogleBot content=NoArchive>"""
    df = kinds(spark, [html, "<p>none"])
    assert [tuple(r) for r in pg.page_metadata(df, ("i",)).orderBy("i").collect()] == [
        (0, "T t", "d", "/c", "NoIndex", "A b"), (1, "", "", "", "", "")]
    assert tuple(pg.page_metadata(df, ("i",), exact=True).orderBy("i").first()) == (0, "T  t", "", "", "NoIndex", "A  b")
    assert tuple(pg.page_metadata_og(df, ("i",)).orderBy("i").first()) == (0, "T t", "d")
    assert tuple(pg.robots_directives(df, ("i",)).orderBy("i").first()) == (0, "noindex", "noarchive")


def test_og_title_wins_and_og_description_stands_in(spark):
    html = "<title>T</title><meta property=og:title content=' O  o '><meta name=description><meta property=og:description content=D>"
    assert tuple(pg.page_metadata_og(kinds(spark, [html]), ()).first()) == ("O o", "D")


def test_null_html_gives_blank_metadata(spark):
    df = spark.createDataFrame([(0, BASE, None)], "i INT, url STRING, html STRING")
    assert tuple(pg.page_metadata(df, ("i",)).first()) == (0, "", "", "", "", "")
