"""Collects the named queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from webloom.registry.fixtures import Tables, sql_views
from webloom.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None, inputs: str = ""):
    """Register a function of ``Tables``; ``check`` is its SQL over the named fixtures."""

    def register(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            prepare(spark)
            return build(Tables(spark, folder))

        QUERIES[name] = run
        if check is not None:
            clause = sql_views(*inputs.split()) if inputs else ""
            body = check.strip()
            if clause and body.upper().startswith("WITH "):
                body = "," + body[4:]
            CHECKS[name] = f"{clause}\n{body}".strip()
        return build

    return register


# SQL pieces shared by the checks. The whitespace class is spelled out: DuckDB's is ASCII.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def collapsed(text: str) -> str:
    return f"trim(regexp_replace({text}, '{SPACE}+', ' ', 'g'), ' ')"


def stripped(text: str) -> str:
    return f"regexp_replace({text}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def unescaped(text: str) -> str:
    """Entities of the test pages; as in browsers, the closing semicolon may be missing."""
    for entity, char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        text = f"regexp_replace({text}, '&{entity};?', '{char}', 'g')"
    return text


def without_tags(html: str) -> str:
    return collapsed(unescaped(f"regexp_replace({html}, '<[^>]*>', ' ', 'g')"))
