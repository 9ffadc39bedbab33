"""Titles to prompts, and stored replies to Markdown documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from webloom.functions.text import extract_chat_reply, extract_reply
from webloom.operators.documents import markdown_document, markdown_files
from webloom.operators.filters import non_blank


def replied_titles(titles: DataFrame, replies: DataFrame, chat: bool = False) -> DataFrame:
    """Non-blank titles with their stored reply, null where none came back."""
    extract = extract_chat_reply if chat else extract_reply
    answered = replies.select("row_id", extract(F.col("reply_json")).alias("reply"))
    return non_blank(titles, "title").join(answered, "row_id", "left")


def title_files(titles: DataFrame, replies: DataFrame) -> DataFrame:
    return markdown_files(replied_titles(titles, replies))


def title_document(titles: DataFrame, replies: DataFrame) -> DataFrame:
    return markdown_document(replied_titles(titles, replies, chat=True))
