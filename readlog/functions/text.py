"""Column expressions for titles, chapters and URLs; all native, none shuffles."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from readlog.schemas import SITE_RULES, STATUSES, TITLE_SUFFIXES, UNKNOWN_TITLE

URL = r"(?i)^(https?)://(?:[^/?#@]*@)?([^/?#:]+)(?::\d+)?([^?#]*)"
REVIEW = r"[\\\s]|/\.\.?(/|$)|[^\x00-\x7f]"


@cache
def fold_table() -> tuple[str, str]:
    """Characters that decompose to one ASCII letter or digit, and those; combining marks follow, without a partner."""
    marks = "".join(map(chr, range(0x300, 0x370)))
    pairs = []
    for code in range(0x80, 0x110000):
        if 0xD800 <= code < 0xE000:
            continue
        plain = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not "̀" <= c <= "ͯ")
        if len(plain) == 1 and plain.isascii() and plain.isalnum() and plain == plain.lower():
            pairs.append((chr(code), plain))
    return "".join(a for a, _ in pairs) + marks, "".join(b for _, b in pairs)


def slug(title: Column) -> Column:
    """The key of a title; "" for null or blank, ``unknown-title`` if nothing is left."""
    plain = F.translate(F.lower(title), *fold_table())
    spaced = F.regexp_replace(F.regexp_replace(plain, r"[^a-z0-9\s-]", " "), r"^\s+|\s+$", "")
    joined = F.regexp_replace(F.regexp_replace(spaced, r"[\s-]+", "-"), f"(-({'|'.join(TITLE_SUFFIXES)}))+$", "")
    blank = title.isNull() | (F.regexp_replace(title, r"(?U)\s+", "") == "")
    return F.when(blank, "").when(joined == "", UNKNOWN_TITLE).otherwise(joined)


def chapter_number(label: Column) -> Column:
    return F.nullif(F.regexp_extract(label, r"[0-9]+([.][0-9]+)?", 0), F.lit("")).cast("double")


def unnumbered(label: Column, number: Column) -> Column:
    """The label where it stands for the chapter, as there is no number. With the number it is the chapter's key."""
    return F.when(number.isNull(), label)


def domain(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def series_key(url: Column) -> Column:
    host, path = F.regexp_extract(url, URL, 2), F.regexp_replace(F.regexp_extract(url, URL, 3), "/+$", "")
    return F.when((host != "") & (path != ""), F.lower(F.concat(host, path)))


def needs_review(url: Column) -> Column:
    """URLs that a browser would rewrite before comparing; their keys may differ from a browser's."""
    return F.coalesce(url.rlike(REVIEW), F.lit(False))


def valid_url(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^(?i)(https?://[^/?#\s]+|(?!https?:)[a-z][a-z0-9+.-]*:\S+)"), F.lit(False))


def site_series_url(url: Column, rules: tuple = SITE_RULES) -> Column:
    """The series URL by the first rule whose domain, or a parent of the host, and pattern match; null if none does."""
    host = F.regexp_replace(domain(url), r"^www\.", "")
    found = None
    for name, pattern, template in rules:
        part = F.regexp_extract(url, "(?i)" + pattern, 1)
        on_site = (host == name) | host.endswith("." + name)
        made = F.when(part != "", F.concat(*[part if x == "$1" else F.lit(x) for x in _parts(template)]))
        found = F.when(on_site, made) if found is None else found.when(on_site, made)
    return found if found is not None else F.lit(None).cast("string")


def _parts(template: str) -> list[str]:
    before, mark, after = template.partition("$1")
    return [x for x in (before, mark, after) if x]


def names_site(title_slug: Column, host_slug: Column) -> Column:
    """Whether a title's slug only names the site."""
    return F.coalesce((host_slug != UNKNOWN_TITLE) & (host_slug != "") & (title_slug == host_slug), F.lit(False))


def site_name_title(title: Column, url: Column) -> Column:
    """Whether the title only names the site."""
    return names_site(slug(title), slug(F.regexp_replace(domain(url), r"^www\.", "")))


def tags(json: Column) -> Column:
    """JSON text to its strings; anything but an array, and items that aren't strings, are dropped."""
    items = F.try_variant_get(F.try_parse_json(json), "$", "array<variant>")
    texts = F.filter(items, lambda x: F.schema_of_variant(x) == "STRING")
    return F.coalesce(F.transform(texts, lambda x: F.try_variant_get(x, "$", "string")), F.array().cast("array<string>"))


def status(value: Column) -> Column:
    return F.when(value.isin(*STATUSES), value).otherwise(STATUSES[0])


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
