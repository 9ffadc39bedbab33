"""Text columns: whitespace, Persian normalisation, searches, prompts and Markdown."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from webloom.fixed_values import FAILED_REPLY, REPLY_KEYS

# The 29 characters Python treats as whitespace: as text and as the inside of a regex class.
WHITESPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(
    map(chr, range(0x2000, 0x200B))
) + "\u2028\u2029\u202f\u205f\u3000"
_CLASS = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# The common single space before a printable character needs no rewriting, and saying so
# first keeps the regex engine off the wide class for nearly every character.
_FINE = "(?![!-~]| [!-~])"
# Zero-width non-joiner and joiner, left-to-right and right-to-left isolates.
_INVISIBLE = r"[\u200c\u200d\u2066\u2067]"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used.

    Spark repeats an expression wherever it stands; the element of an array is computed by itself.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def collapse_ws(col: Column) -> Column:
    """Runs of whitespace become one space, none at the ends."""
    return F.trim(F.regexp_replace(col, f"{_FINE}[{_CLASS}]+", " "))


def clean_text(col: Column) -> Column:
    """As ``collapse_ws``, with NUL counted as a space and null as empty text."""
    clean = F.trim(F.regexp_replace(col, f"{_FINE}[\\x00{_CLASS}]+", " "))
    return F.coalesce(clean, F.lit(""))


def normalize_persian(col: Column) -> Column:
    """Joiners and isolates removed, then whitespace collapsed; null is empty text."""
    visible = F.regexp_replace(col.cast("string"), _INVISIBLE, "")
    return F.coalesce(collapse_ws(visible), F.lit(""))


def words_in(normalized: Column) -> Column:
    """Words of a text that already went through a whitespace collapse and is cheap to repeat."""
    spaces = F.length(normalized) - F.length(F.translate(normalized, " ", ""))
    return F.when(normalized == "", F.lit(0)).otherwise(spaces + 1)


def word_count(normalized: Column) -> Column:
    """Words of a text that went through a whitespace collapse."""
    return bound(normalized, words_in)


def contains_ci(col: Column, literal: str) -> Column:
    """Case-insensitive literal search; null never matches."""
    found = F.contains(F.lower(col.cast("string")), F.lower(F.lit(literal)))
    return F.coalesce(found, F.lit(False))


def regex_search_ci(col: Column, pattern: str) -> Column:
    """Case-insensitive Java regex search; empty or null text never matches."""
    return F.coalesce((col != "") & col.rlike(f"(?iuU){pattern}"), F.lit(False))


def truncate_display(col: Column, size: int) -> Column:
    return F.when(F.length(col) > size, F.concat(F.substring(col, 1, size), F.lit("..."))).otherwise(col)


def build_prompt(base: str, title: Column) -> Column:
    return F.concat(F.lit(f"{base}\ntitle:\n"), title)


def extract_reply(reply_json: Column) -> Column:
    """The first present answer field, else the whole object as JSON text; null if it is no JSON."""
    fields = [F.get_json_object(reply_json, f"$.{key}") for key in REPLY_KEYS]
    return F.when(F.try_parse_json(reply_json).isNotNull(), strip(F.coalesce(*fields, reply_json)))


def extract_chat_reply(reply_json: Column) -> Column:
    return strip(F.get_json_object(reply_json, "$.choices[0].message.content"))


def markdown_block(title: Column, reply: Column, style: str = "file") -> Column:
    """``file``: a document of its own; ``section``: a part of one long document."""
    body = F.when(F.coalesce(reply, F.lit("")) == "", F.lit(FAILED_REPLY)).otherwise(reply)
    if style == "section":
        return F.concat(F.lit("## "), title, F.lit("\n\n"), body, F.lit("\n\n---\n\n"))
    if style == "file":
        return F.concat(F.lit("# "), title, F.lit("\n\n"), body, F.lit("\n"))
    raise ValueError(f"unknown Markdown style: {style}")


def safe_filename(title: Column, row_number: Column) -> Column:
    """Letters, digits and `` -_()`` survive; a blank rest becomes ``title_<row>``."""
    kept = F.trim(F.regexp_replace(title, r"[^\p{L}\p{N} \-_()]", ""))
    return F.when(kept == "", F.concat(F.lit("title_"), row_number.cast("string"))).otherwise(kept)
