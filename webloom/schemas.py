"""Declared row types of the stored tables and the headers of the reports."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType,
)


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


_S, _I, _L, _D, _B = StringType(), IntegerType(), LongType(), DoubleType(), BooleanType()

URL_LIST = _struct(row_id=_L, url=_S)

# One row per (site, url): a stored crawl snapshot.
PAGES = _struct(
    site=_S, url=_S, status=_I, first_status=_I, content_type=_S, html=_S, error=_S,
)
STARTS = _struct(site=_S, start_url=_S)
FETCH_LOG = _struct(site_id=_L, seq=_L, url=_S, status=_I, retry_after=_S)

INSPECTION_RESPONSE = _struct(row_id=_L, url=_S, response_json=_S, api_error=_S)
INSPECTION_JSON = _struct(
    inspectionResult=_struct(
        inspectionResultLink=_S,
        indexStatusResult=_struct(
            verdict=_S, coverageState=_S, indexingState=_S, lastCrawlTime=_S, pageFetchState=_S,
            robotsTxtState=_S, crawledAs=_S, googleCanonical=_S, userCanonical=_S,
        ),
    )
)

BOX = _struct(x=_I, y=_I, w=_I, h=_I)
DETECTIONS = _struct(
    clip_id=_L, frame_index=_L, k=_I, area=_D, x=_I, y=_I, w=_I, h=_I, frame_size=_L,
)
FRAMES = _struct(
    clip_id=_L, frame_index=_L, fps=_D, width=_I, height=_I, decoded=_B, boxes=ArrayType(BOX),
    score=_D, uncertain=_B, view_matches=_B,
)
CLIPS = _struct(clip_id=_L, path=_S, camera_profile=_S, fps=_D, frames=_L, expected_frames=_L)
STATE = _struct(path=_S, fingerprint=_S, processing_status=_S, updated_at=_L)

PAGE_REPORT_HEADERS = {
    "url": "URL", "title": "Title", "description": "Description", "canonical": "Canonical",
    "meta_robots": "Meta Robots", "h1": "H1", "status_code": "Status Code",
}
LINK_REPORT_HEADERS = {
    "source": "source", "destination": "destination", "anchor_text": "anchor text",
    "status_code": "status code",
}
