"""One pass over stored HTML, giving Spark everything the page operators need.

The reader keeps a stack of open elements and emits plain facts: heading texts, meta
tags, and for each link where it stands. Choosing among them (which title wins, which
content root counts, which links are kept) is left to column expressions.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.pandas.types import from_arrow_type

from webloom.fixed_values import (
    CONTENT_CLASSES, CONTENT_IDS, EXCLUDED_COMPOUND_WORDS, EXCLUDED_ROLES, EXCLUDED_TAGS,
    EXCLUDED_TOKENS, IDENTIFIER_ATTRIBUTES, LAYOUT_CLASSES, LAYOUT_IDS, LAYOUT_ROLES,
    LAYOUT_TAGS, LEGACY_EXCLUDED_NAMES, LEGACY_EXCLUDED_ROLES, LEGACY_EXCLUDED_TAGS,
    LEGACY_EXCLUDED_WORDS, OVERLAY_CLASSES, OVERLAY_EDGE_CLASSES, OVERLAY_MIN_LINKS,
)
from webloom.functions.urls import absolute_url, host_of

_META = pa.struct([("name", pa.string()), ("property", pa.string()), ("content", pa.string())])
_REL_LINK = pa.struct([("rel", pa.string()), ("href", pa.string())])
_LINK = pa.struct([
    ("href", pa.string()), ("target", pa.string()), ("internal", pa.bool_()), ("anchor", pa.string()),
    ("in_main", pa.bool_()), ("in_named", pa.bool_()), ("in_article", pa.bool_()),
    ("after_h1", pa.bool_()), ("excluded", pa.bool_()),
])
_FACTS = {
    "error": [("parse_error", pa.string())],
    "head": [("title", pa.string()), ("h1", pa.string()), ("h1_raw", pa.string()), ("metas", pa.list_(_META)),
             ("rel_links", pa.list_(_REL_LINK))],
    "text": [("main_text", pa.string())],
    "links": [("has_main", pa.bool_()), ("has_named", pa.bool_()), ("has_article", pa.bool_()),
              ("has_h1", pa.bool_()), ("links", pa.list_(_LINK))],
}

_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
# An opening tag ends an unfinished element of these kinds directly above it.
_ENDED_BY = {
    "p": frozenset(
        "p div ul ol dl table form h1 h2 h3 h4 h5 h6 pre blockquote article section main "
        "header footer nav aside".split()
    ),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "option": frozenset(["option"]), "a": frozenset(["a"]),
    "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]),
    "tr": frozenset(["tr"]), "head": frozenset(["body"]),
}
# A closing tag does not reach past an open element of a higher rank than its own.
_RANK = {"div": 1, "td": 2, "th": 2, "tr": 3, "thead": 4, "tbody": 4, "tfoot": 4, "table": 5,
         "head": 6, "body": 6, "html": 7}
_NO_TEXT = frozenset(["script", "style", "template", "rt", "rp"])

# Where an element stands, inherited by everything inside it.
EXCLUDED, IN_MAIN, IN_NAMED, IN_ARTICLE, LAYOUT, HEAD, NO_TEXT = (1 << i for i in range(7))



def _one_of(words) -> str:
    return "(?:" + "|".join(map(re.escape, words)) + ")"


# A token between characters no token holds; or a word set off by hyphens or the value's ends.
_NAVIGATION = re.compile(
    rf"(?<![a-z0-9-]){_one_of(EXCLUDED_TOKENS)}(?![a-z0-9-])|(?:^|-){_one_of(EXCLUDED_COMPOUND_WORDS)}(?:-|$)"
)
_LEGACY_NAVIGATION = re.compile(
    rf"\A{_one_of(LEGACY_EXCLUDED_NAMES)}\Z|(?<![a-z0-9]){_one_of(LEGACY_EXCLUDED_WORDS)}(?![a-z0-9])|\Amenu-|-menu\Z"
)
_ALONE, _PLACED, _AT_EDGE = 1, 2, 4
_OVERLAY: dict[str, int] = {"absolute": _PLACED}
for _bit, _names in ((_ALONE, OVERLAY_CLASSES), (_AT_EDGE, OVERLAY_EDGE_CLASSES)):
    for _name in _names:
        _OVERLAY[_name] = _OVERLAY.get(_name, 0) | _bit


@lru_cache(maxsize=65536)
def names_navigation(value: str, legacy_rule: bool = False) -> bool:
    """Whether an id, class or label value says menu, header, footer and the like."""
    rule = _LEGACY_NAVIGATION if legacy_rule else _NAVIGATION
    return rule.search(value.strip().lower().replace("_", "-")) is not None


def names_navigation_legacy(value: str) -> bool:
    return names_navigation(value, True)


def is_excluded_area(attrs: dict[str, str], classes: list[str]) -> bool:
    """By attributes; tags are in ``_TAG_PLACE``."""
    if attrs.get("role", "").strip().lower() in EXCLUDED_ROLES:
        return True
    if attrs.get("aria-modal", "").strip().lower() == "true":
        return True
    values = [attrs[a] for a in IDENTIFIER_ATTRIBUTES if a != "class" and attrs.get(a)]
    return any(names_navigation(v) for v in values + classes)


def is_excluded_area_legacy(attrs: dict[str, str], classes: list[str]) -> bool:
    if attrs.get("role", "").strip().lower() in LEGACY_EXCLUDED_ROLES:
        return True
    values = [attrs["id"]] if attrs.get("id", "").strip() else []
    return any(names_navigation_legacy(v) for v in values + classes)


def is_overlay(classes: list[str]) -> bool:
    """Placed over the page by utility classes; variants such as ``md:fixed`` count."""
    seen = 0
    for name in classes:
        seen |= _OVERLAY.get(name.lower().rpartition(":")[2], 0)
    return bool(seen & _ALONE) or seen & (_PLACED | _AT_EDGE) == _PLACED | _AT_EDGE


def is_layout(attrs: dict[str, str], classes: list[str]) -> bool:
    return (
        attrs.get("role") in LAYOUT_ROLES
        or attrs.get("id") in LAYOUT_IDS
        or any(c in LAYOUT_CLASSES for c in classes)
    )


def _tag_place(excluded_tags: tuple[str, ...]) -> dict[str, int]:
    """What a tag alone says about the place of its content."""
    kinds = (
        (EXCLUDED, excluded_tags), (IN_MAIN, ("main",)), (IN_ARTICLE, ("article",)), (LAYOUT, LAYOUT_TAGS),
        (HEAD, ("head", "title")), (NO_TEXT, _NO_TEXT),
    )
    places: dict[str, int] = {}
    for bit, tags in kinds:
        for tag in tags:
            places[tag] = places.get(tag, 0) | bit
    return places


_TAG_PLACE = _tag_place(EXCLUDED_TAGS)
_LEGACY_TAG_PLACE = _tag_place(LEGACY_EXCLUDED_TAGS)
# Elements with none of these attributes, the great majority, are placed by tag alone.
_TELLING = frozenset((*IDENTIFIER_ATTRIBUTES, "role", "aria-modal"))


class _Open:
    """An element whose end has not been seen."""

    __slots__ = ("tag", "place", "sinks", "area_sink", "overlay_from")

    def __init__(self, tag: str, place: int) -> None:
        self.tag, self.place = tag, place
        self.sinks: tuple[list[str], ...] = ()
        self.area_sink: list[str] | None = None
        self.overlay_from: int | None = None


_LONG_REFERENCE = re.compile(r"&#0*([1-9]\d{7})\d+|&#0+(?=[1-9])")


class PageReader(HTMLParser):
    """Collects the facts of one page while reading it once; memory is one page."""

    def __init__(self, url: str, legacy_rule: bool = False) -> None:
        super().__init__(convert_charrefs=True)
        self.url = url
        self.legacy_rule = legacy_rule
        self.excludes = is_excluded_area_legacy if legacy_rule else is_excluded_area
        self.tag_place = _LEGACY_TAG_PLACE if legacy_rule else _TAG_PLACE
        self.stack: list[_Open] = []
        self.open_tags: Counter[str] = Counter()
        self.pending: list[str] = []
        self.sinks: list[list[str]] = []
        self.area_sinks: list[list[str]] = []
        self.title: list[str] | None = None
        self.h1: list[str] | None = None
        self.h1_raw: list[str] | None = None
        self.raw_depth = 0
        self.metas: list[dict] = []
        self.rel_links: list[dict] = []
        self.links: list[dict] = []
        self.open_links: list[dict] = []
        self.seen_place = 0
        self.body: list[str] = []
        self.main: list[str] | None = None
        self.article: list[str] | None = None

    # --- reader events ---
    def handle_data(self, data: str) -> None:
        self.pending.append(data)

    def handle_comment(self, data: str) -> None:
        self.flush()

    def handle_pi(self, data: str) -> None:
        self.flush()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.flush()
        while self.stack and tag in _ENDED_BY.get(self.stack[-1].tag, ()):
            self.leave()
        given: dict[str, str] = {}
        for name, value in attrs:
            given.setdefault(name, value or "")
        if tag == "meta":
            self.metas.append({k: given.get(k) for k in ("name", "property", "content")})
        elif tag == "link":
            self.rel_links.append({k: given.get(k) for k in ("rel", "href")})
        elif tag == "img" and "alt" in given:
            for link in self.open_links:
                link.setdefault("alt", given["alt"])
        if tag not in _VOID:
            self.enter(tag, given)

    def handle_endtag(self, tag: str) -> None:
        self.flush()
        if not self.open_tags[tag]:
            return
        rank = _RANK.get(tag, 0)
        for depth in range(len(self.stack) - 1, -1, -1):
            name = self.stack[depth].tag
            if name == tag:
                while len(self.stack) > depth:
                    self.leave()
                return
            if _RANK.get(name, 0) > rank:
                return

    # --- open elements ---
    def enter(self, tag: str, attrs: dict[str, str]) -> None:
        outer = self.stack[-1].place if self.stack else 0
        place = outer | self.tag_place.get(tag, 0)
        classes: list[str] = []
        if not _TELLING.isdisjoint(attrs):
            classes = attrs.get("class", "").split()
            if self.excludes(attrs, classes):
                place |= EXCLUDED
            if attrs.get("role") == "main":
                place |= IN_MAIN
            if attrs.get("id") in CONTENT_IDS or any(c in CONTENT_CLASSES for c in classes):
                place |= IN_NAMED
            if is_layout(attrs, classes):
                place |= LAYOUT
        self.seen_place |= place

        node = _Open(tag, place)
        if tag == "title" and self.title is None:
            self.title = []
            node.sinks = (self.title,)
        elif tag == "h1" and self.h1 is None:
            self.h1, self.h1_raw = [], []
            self.raw_depth = len(self.stack) + 1
            node.sinks = (self.h1,)
        elif tag == "a" and "href" in attrs:
            link = {"href": attrs["href"].strip(), "texts": [], "place": outer,
                    "after_h1": self.h1 is not None}
            self.links.append(link)
            self.open_links.append(link)
            node.sinks = (link["texts"],)
        elif tag == "main" and self.main is None and not place & LAYOUT:
            node.area_sink = self.main = []
        elif tag == "article" and self.article is None and not place & LAYOUT:
            node.area_sink = self.article = []
        if classes and not self.legacy_rule and is_overlay(classes):
            node.overlay_from = len(self.links)
        self.sinks += node.sinks
        if node.area_sink is not None:
            self.area_sinks.append(node.area_sink)
        self.stack.append(node)
        self.open_tags[tag] += 1

    def leave(self) -> None:
        if len(self.stack) == self.raw_depth:
            self.raw_depth = 0
        node = self.stack.pop()
        self.open_tags[node.tag] -= 1
        if node.sinks:
            del self.sinks[-len(node.sinks):]
            if node.tag == "a":
                self.open_links.pop()
        if node.area_sink is not None:
            self.area_sinks.pop()
        if node.overlay_from is not None and len(self.links) - node.overlay_from >= OVERLAY_MIN_LINKS:
            for link in self.links[node.overlay_from:]:
                link["place"] |= EXCLUDED

    def flush(self) -> None:
        """One text node ends here: hand it to whoever collects text at this point."""
        if not self.pending:
            return
        raw = "".join(self.pending)
        text = raw.strip()
        self.pending.clear()
        place = self.stack[-1].place if self.stack else 0
        if self.raw_depth and not place & NO_TEXT:
            self.h1_raw.append(raw)
        if not text or place & NO_TEXT:
            return
        for sink in self.sinks:
            sink.append(text)
        if not place & (LAYOUT | HEAD):
            self.body.append(text)
            for sink in self.area_sinks:
                sink.append(text)

    # --- results ---
    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Unknown sections such as ``<![foo[`` end at the next ``>``, as in browsers."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i)

    def read(self, html: str) -> "PageReader":
        # Numbers of thousands of digits are refused by Python; any beyond Unicode means the same.
        self.feed(_LONG_REFERENCE.sub(r"&#\1", html))
        # As in browsers, a tag or comment that the page never finishes is dropped with all
        # behind it. ``close`` would try every later "<" anew, in quadratic time.
        if not self.rawdata.startswith("<") or self.rawdata == "<":
            self.close()
        self.flush()
        while self.stack:
            self.leave()
        return self

    def head_facts(self) -> dict:
        return {
            "title": None if self.title is None else " ".join(self.title),
            "h1": None if self.h1 is None else " ".join(self.h1),
            "h1_raw": None if self.h1_raw is None else "".join(self.h1_raw),
            "metas": self.metas,
            "rel_links": self.rel_links,
        }

    def text_facts(self) -> dict:
        found = next((t for t in (self.main, self.article) if t is not None), self.body)
        return {"main_text": " ".join(found)}

    def link_facts(self) -> dict:
        links = []
        host = host_of(self.url)
        for link in self.links:
            target = absolute_url(self.url, link["href"])
            anchor = " ".join(" ".join(link["texts"]).split()) or " ".join(link.get("alt", "").split())
            place = link["place"]
            links.append({
                "href": link["href"], "target": target, "internal": target != "" and host_of(target) == host,
                "anchor": anchor,
                "in_main": bool(place & IN_MAIN), "in_named": bool(place & IN_NAMED),
                "in_article": bool(place & IN_ARTICLE), "after_h1": link["after_h1"],
                "excluded": bool(place & EXCLUDED),
            })
        seen = self.seen_place
        return {
            "has_main": bool(seen & IN_MAIN), "has_named": bool(seen & IN_NAMED),
            "has_article": bool(seen & IN_ARTICLE), "has_h1": self.h1 is not None, "links": links,
        }


def read_page(
    url: str, html: str, head: bool = True, text: bool = True, links: bool = True, legacy_rule: bool = False
) -> dict:
    """Facts of one page as a dictionary.

    A page that cannot be read to its end yields the error text and the facts before it.
    """
    page = PageReader(url, legacy_rule)
    facts: dict = {"parse_error": None}
    try:
        page.read(html)
    except Exception as error:  # bad input must not fail the job; every plan reports it
        facts["parse_error"] = f"{type(error).__name__}: {error}"
    if head:
        facts |= page.head_facts()
    if text:
        facts |= page.text_facts()
    if links:
        facts |= page.link_facts()
    return facts


def parse_page(
    url: Column, html: Column, *, head: bool = False, text: bool = False, links: bool = False,
    legacy_rule: bool = False,
) -> Column:
    """Struct of page facts; only the wanted groups are built and sent back to the JVM.

    A null ``html`` gives a null struct.
    """
    wanted = {"error": True, "head": head, "text": text, "links": links}
    facts_type = pa.struct([field for group, on in wanted.items() if on for field in _FACTS[group]])

    @F.arrow_udf(from_arrow_type(facts_type))
    def reader(urls: pa.Array, pages: pa.Array) -> pa.Array:
        rows = [
            None if page is None else read_page(base or "", page, head, text, links, legacy_rule)
            for base, page in zip(urls.to_pylist(), pages.to_pylist())
        ]
        return pa.array(rows, facts_type)

    return reader(url, html)
