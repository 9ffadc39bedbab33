"""URL columns. Plain string functions: ``parse_url`` rejects hosts and characters seen in the wild."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache
from urllib.parse import urljoin, urlparse, uses_params

import pyarrow as pa
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession, functions as F
from pyspark.sql.types import StringType

from webloom.fixed_values import HTTP_SCHEMES, SKIPPED_HREF_PREFIXES, UNWANTED_EXTENSIONS
from webloom.functions.text import strip

_URL = r"^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)"
_SCHEME, _AUTHORITY, _PATH = 1, 2, 3


def _as_parsed(url: Column) -> Column:
    """What a URL parser sees: control characters cut at the front, tabs and line ends gone."""
    return F.regexp_replace(url, r"^[\x00-\x20]+|[\t\r\n]", "")


def authority(url: Column) -> Column:
    return F.lower(F.regexp_extract(_as_parsed(url), _URL, _AUTHORITY))


def normalize_url(url: Column) -> Column:
    """One spelling per http(s) URL, without fragment; everything else is empty text."""
    text = _as_parsed(strip(F.coalesce(url, F.lit(""))))
    no_fragment = F.substring_index(text, "#", 1)
    base = F.substring_index(no_fragment, "?", 1)
    query = F.substr(no_fragment, F.length(base) + 2)
    scheme = (
        F.when(F.lower(F.substring(base, 1, 5)) == "http:", F.lit("http"))
        .when(F.lower(F.substring(base, 1, 6)) == "https:", F.lit("https"))
    )
    rest = F.substr(base, F.length(scheme) + 2)
    host = F.when(rest.startswith("//"), F.substring_index(F.substr(rest, F.lit(3)), "/", 1)).otherwise("")
    after_host = F.when(rest.startswith("//"), F.substr(rest, F.length(host) + 3)).otherwise(rest)
    # A parameter mark with nothing behind it is not kept.
    path = F.regexp_replace(after_host, r"(^|/)([^/;]*);$", "$1$2")
    # An empty path becomes the root, in front of parameters, too.
    path = F.regexp_replace(path, r"^(;[^/]*)?$", "/$1")
    location = (
        F.when(host != "", F.concat(F.lit("//"), F.lower(host), path))
        .when(path.startswith("/"), F.concat(F.lit("//"), path))
        .otherwise(path)
    )
    suffix = F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")
    return F.when(scheme.isNotNull(), F.concat(scheme, F.lit(":"), location, suffix)).otherwise("")


# A root path without dot segments, parameters, query or fragment.
_PLAIN_PATH = re.compile(r"/(?!/)[\w~%./-]*", re.ASCII)


@lru_cache(maxsize=4096)
def _origin(base: str) -> str:
    """``scheme://host`` of a web page, else empty text."""
    try:
        url = urlparse(base)
    except ValueError:
        return ""
    return f"{url.scheme}://{url.netloc.lower()}" if url.scheme in HTTP_SCHEMES and url.netloc else ""


def absolute_url(base: str, href: str) -> str:
    """Resolve one href and normalise it as ``normalize_url`` does; runs inside Python workers."""
    # The usual link within a site needs no URL parser.
    if "/." not in href and _PLAIN_PATH.fullmatch(href) and (origin := _origin(base)):
        return origin + href
    try:
        url = urlparse(urljoin(base, href).strip())
    except ValueError:
        return ""
    if url.scheme not in HTTP_SCHEMES:
        return ""
    return url._replace(netloc=url.netloc.lower(), path=url.path or "/", fragment="").geturl()


def host_of(url: str) -> str:
    """Lower-case authority, as ``authority`` gives; runs inside Python workers."""
    try:
        return urlparse(url).netloc.lower()
    except ValueError:
        return ""


@F.arrow_udf(StringType())
def _resolve(base: pa.Array, href: pa.Array) -> pa.Array:
    return pa.array(
        [
            None if b is None or h is None else absolute_url(b, h)
            for b, h in zip(base.to_pylist(), href.to_pylist())
        ],
        pa.string(),
    )


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute, normalised form of an href. No built-in follows the relative-URL rules."""
    return _resolve(base, href)


def ensure_scheme(col: Column) -> Column:
    """Prefix ``https://`` where no scheme is written; blank and null become empty text."""
    url = strip(F.coalesce(col.cast("string"), F.lit("")))
    has_scheme = F.regexp_extract(_as_parsed(url), _URL, _SCHEME) != ""
    return F.when((url == "") | has_scheme, url).otherwise(F.concat(F.lit("https://"), url))


def ensure_http(col: Column) -> Column:
    """Prefix ``https://`` unless the text starts with an http(s) scheme, case mattering."""
    return F.when(col.startswith("http://") | col.startswith("https://"), col).otherwise(
        F.concat(F.lit("https://"), col)
    )


def is_internal(url: Column, domain: Column) -> Column:
    return authority(url) == F.lower(domain)


def has_unwanted_extension(url: Column) -> Column:
    path, scheme = (F.lower(F.regexp_extract(_as_parsed(url), _URL, part)) for part in (_PATH, _SCHEME))
    endings = "|".join(re.escape(e) for e in UNWANTED_EXTENSIONS)
    # Parameters of the last segment are not part of the path, where the scheme knows any.
    whole = path.rlike(f"(?:{endings})$")
    return F.when(scheme.isin(*uses_params), path.rlike(f"(?:^|/)[^/;]*(?:{endings})(?:;[^/]*)?$")).otherwise(whole)


def _is_regex(pattern: str) -> bool:
    """Whether the engine that will run the pattern accepts it; asked once, on the driver."""
    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException:
        return False
    return True


def matches_skip(url: Column, patterns: Sequence[str]) -> Column:
    """True when any pattern is found; one that is no valid Java regex is searched as plain text.

    Classes such as ``\\w`` are Unicode's.
    """
    found = F.lit(False)
    for pattern in patterns:
        found = found | (url.rlike(f"(?U){pattern}") if _is_regex(pattern) else F.contains(url, F.lit(pattern)))
    return found


def parse_skip_patterns(text: str) -> list[str]:
    return [part.strip() for part in text.split(",") if part.strip()]


def is_navigable_href(href: Column) -> Column:
    """Not blank, not a bare ``#``, not mail, phone, script or inline data."""
    text = strip(href)
    other = "|".join(SKIPPED_HREF_PREFIXES)
    return F.coalesce((text != "") & (text != "#") & ~F.lower(text).rlike(f"^(?:{other}):"), F.lit(False))
