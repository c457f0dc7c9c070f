"""Fixed schemas, thresholds and catalogues."""

from __future__ import annotations

from pyspark.sql import types as T

_s, _ts, _d, _i, _b = T.StringType(), T.TimestampType(), T.DoubleType(), T.IntegerType(), T.BinaryType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


SERIES = _schema(
    id=_s, canonical_name=_s, slug=_s, cover_url=_s, cover_image=_b, cover_image_type=_s, cover_version=_i, status=_s, tags=_s,
    created_at=_ts, updated_at=_ts, deleted_at=_ts, merged_into_slug=_s,
)
EVENTS = _schema(id=_s, series_id=_s, chapter_label=_s, chapter_number=_d, source_url=_s, source_domain=_s, read_at=_ts, series_key=_s)
REPORTS = _schema(report_id=_s, manga_name=_s, chapter_label=_s, source_url=_s, cover_url=_s, series_url=_s, read_at=_ts)
DISMISSALS = _schema(slug_a=_s, slug_b=_s, created_at=_ts, updated_at=_ts)
ADAPTERS = _schema(id=_s, domain=_s, title_selector=_s, chapter_selector=_s, chapter_url_regex=_s, created_at=_ts, updated_at=_ts)
COVERS = _schema(slug=_s, data=_b, content_type=_s, cover_version=_i)

# Thresholds, limits, word lists and site patterns that results depend on.
AUTO_MERGE_SCORE = 0.92
SUGGEST_SCORE = 0.75
TOKEN_MATCH = 0.8
MAX_HOPS = 16
MAX_COVER_BYTES = 5 * 1024 * 1024
MAX_REFERERS = 4
BURST_SECONDS = 5
STATUSES = ("reading", "completed", "dropped")
TITLE_SUFFIXES = ("manga", "manhwa", "manhua", "comic", "novel")
UNKNOWN_TITLE = "unknown-title"
SEQUEL_MARKERS = (
    "season", "temporada", "parte", "part", "ii", "iii", "iv", "gaiden", "spinoff", "spin", "sequel", "prequel", "remake", "reboot",
    "colored", "color", "after", "final", "origin", "origins", "side", "story", "0", "2", "3", "4", "5", "6",
)
#: (domain, pattern of a chapter URL, template of the series URL), first match wins.
SITE_RULES = (
    ("manhwaweb.com", r"^https?://(?:www\.)?manhwaweb\.com/leer/(.+_\d{10,})-\d+(?:[.,]\d+)?(?:_\d+)?/?$", "https://manhwaweb.com/leer/$1"),
    ("olympusxyz.com", r"^https?://(?:www\.)?olympusxyz\.com/capitulo/\d+/([^/?#]+?)(?:-\d{8}-\d{6,12})?/?$", "https://olympusxyz.com/$1"),
)
