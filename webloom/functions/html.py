"""HTML extraction as one Arrow-batched function: title, description, headings, links.

A page is read once into a flat list of events; each field is then a small rule over events.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from html import escape
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..shipping import ship
from .wire import decode_html

PAGE = "struct<title:string,description:string,headings:array<string>,links:array<string>,text_encoding:string,error:string>"
PAGE_FIELDS = ["title", "description", "headings", "links", "text_encoding", "error"]
#: Where a tag keeps the URL it links to.
LINK_ATTRIBUTE = {"a": "href", "area": "href", "iframe": "src", "frame": "src"}
HEADINGS = frozenset(f"h{n}" for n in range(1, 7))


class _Events(HTMLParser):
    """('open', tag, attributes), ('close', tag, None) and ('text', None, data) in order."""

    def __init__(self, text: str):
        super().__init__(convert_charrefs=True)
        self.events: list[tuple] = []
        self.feed(text)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.events.append(("open", tag, {k: v for k, v in attrs if v is not None}))

    def handle_endtag(self, tag):
        self.events.append(("close", tag, None))

    def handle_data(self, data):
        self.events.append(("text", None, data))


def _squeezed(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def title_of(events) -> str | None:
    """The last title. One never closed ends at the next tag, as raw text would have been."""
    last = max((i for i, (kind, tag, _) in enumerate(events) if (kind, tag) == ("open", "title")), default=None)
    if last is None:
        return None
    closed = any((kind, tag) == ("close", "title") for kind, tag, _ in events)
    parts = []
    for kind, tag, data in events[last + 1 :]:
        if kind == "text":
            parts.append(data)
        elif (kind, tag) == ("close", "title") or not closed:
            break
    return _squeezed(parts if closed else ["".join(parts).split("<", 1)[0]]) or None


def headings_of(events) -> list[str]:
    """Closed h1 to h6; another level inside counts as text of the outer one."""
    out, inside, parts = [], None, []
    for kind, tag, data in events:
        if kind == "open" and tag in HEADINGS and inside is None:
            inside, parts = tag, []
        elif kind == "close" and inside is not None and tag == inside:
            out.append(_squeezed(parts))
            inside = None
        elif kind == "text" and inside is not None:
            parts.append(data)
    return [h for h in out if h]


def description_of(events) -> str | None:
    """meta description, or else og:description; the last of each counts."""
    found = {}
    for kind, tag, attrs in events:
        if kind == "open" and tag == "meta" and attrs.get("content"):
            found[(attrs.get("name") or attrs.get("property") or "").lower()] = attrs["content"].strip()
    return found.get("description") or found.get("og:description")


def hrefs_of(events) -> tuple[list[str], str | None]:
    opened = [(tag, attrs) for kind, tag, attrs in events if kind == "open"]
    hrefs = [attrs[LINK_ATTRIBUTE[tag]] for tag, attrs in opened if tag in LINK_ATTRIBUTE and attrs.get(LINK_ATTRIBUTE[tag])]
    return hrefs, next((attrs["href"] for tag, attrs in opened if tag == "base" and attrs.get("href")), None)


def resolved_links(hrefs: list[str], base: str) -> list[str]:
    """http(s) links without fragments, in order of first mention. A malformed link is dropped."""
    seen: dict[str, None] = {}
    for href in map(str.strip, hrefs):
        if href and href[0] != "#":
            try:
                url = urldefrag(urljoin(base, href)).url
            except ValueError:
                continue
            if url.startswith(("http://", "https://")):
                seen.setdefault(url)
    return list(seen)


FIELDS = frozenset({"title", "description", "headings", "links"})


def parse_page(body: bytes | str, url: str, content_type: str | None = "", fields: frozenset[str] = FIELDS) -> dict:
    """One page as a dict of PAGE's fields; a body that cannot be read gives only ``error``."""
    none = {"title": None, "description": None, "headings": None, "links": None, "text_encoding": None}
    if body is None:
        return none | {"error": "parse_error"}
    if isinstance(body, str):
        text, encoding = body, "utf-8"
    else:
        text, encoding, error = decode_html(body, content_type or "")
        if error:
            return none | {"error": error}
    try:
        events = _Events(text).events
    except (AssertionError, ValueError):  # markup that the parser refuses
        return none | {"error": "parse_error"}
    try:
        return _page(events, url or "", encoding, fields)
    except Exception:  # a page must not end the job
        return none | {"error": "internal_parse_error"}


def _page(events, url: str, encoding: str, fields: frozenset[str]) -> dict:
    out = {"title": None, "description": None, "headings": None, "links": None, "text_encoding": encoding, "error": None}
    if "title" in fields:
        out["title"] = title_of(events)
    if "description" in fields:
        out["description"] = description_of(events)
    if "headings" in fields:
        out["headings"] = headings_of(events)
    if "links" in fields:
        hrefs, base = hrefs_of(events)
        try:
            base = urljoin(url, base) if base else url
        except ValueError:
            base = url
        out["links"] = resolved_links(hrefs, base)
    return out


def _parse_series(body: pd.Series, url: pd.Series, content_type: pd.Series) -> pd.DataFrame:
    return _frame(body, url, content_type, FIELDS)


def _frame(body, url, content_type, fields) -> pd.DataFrame:
    return pd.DataFrame([parse_page(b, u, c, fields) for b, u, c in zip(body, url, content_type)], columns=PAGE_FIELDS)


def parse_html(body: Column | str, url: Column | str, content_type: Column | str | None = None, fields=FIELDS) -> Column:
    """PAGE struct of string or binary bodies; only the wanted ``fields`` are made."""
    ship()
    wanted = frozenset(fields)

    def run(body: pd.Series, url: pd.Series, content_type: pd.Series) -> pd.DataFrame:
        return _frame(body, url, content_type, wanted)

    return F.pandas_udf(run, PAGE)(body, url, F.lit("") if content_type is None else content_type)


def parsed_by(parse: Callable[[bytes, str, str], Mapping], body: Column | str, url: Column | str, content_type: Column | str) -> Column:
    """PAGE struct by a parser of the caller's: a function of (body, url, content type) to a mapping with
    some of PAGE's fields. What it leaves out is null (no headings, no links); links are made absolute
    against the URL and deduplicated; a page that it raises on has the error ``internal_parse_error``."""
    ship()

    def one(body, url, content_type) -> dict:
        none = dict.fromkeys(PAGE_FIELDS) | {"headings": [], "links": []}
        if body is None:
            return none | {"error": "parse_error"}
        try:
            got = dict(parse(bytes(body), url or "", content_type or ""))
            if unknown := got.keys() - none.keys():
                raise ValueError(f"no such fields: {sorted(unknown)}")
            got["links"] = resolved_links(got.get("links") or [], url or "")
            return none | {k: v for k, v in got.items() if v is not None}
        except Exception:  # a page must not end the job
            return none | {"error": "internal_parse_error"}

    def run(body: pd.Series, url: pd.Series, content_type: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(*row) for row in zip(body, url, content_type)], columns=PAGE_FIELDS)

    return F.pandas_udf(run, PAGE)(body, url, content_type)


def html_escape(text: Column | str) -> Column:
    out = F.col(text) if isinstance(text, str) else text
    for char in "&<>\"'":
        out = F.replace(out, F.lit(char), F.lit(escape(char)))
    return out
