"""A small site of our own as a table: the routes that a crawl must handle, with fixed answers."""

from __future__ import annotations

import gzip

from pyspark.sql import DataFrame, SparkSession

HTML = "text/html; charset=utf-8"


def _page(title: str, body: str, head: str = "") -> bytes:
    return f"<!doctype html><html><head><title>{title}</title>{head}</head><body>{body}</body></html>".encode()


def routes() -> dict[str, tuple[int, dict[str, str], bytes]]:
    home = _page("Fixture Page", '<h1>Fixture Heading</h1><a href="/page2">2</a><a href="/blocked">b</a><a href="/redirect">r</a>', '<meta name="description" content="Fixture description">')
    return {
        "/robots.txt": (200, {"content-type": "text/plain"}, b"User-agent: *\nDisallow: /blocked\nCrawl-delay: 0.1\n"),
        "/": (200, {"content-type": HTML}, home),
        "/page": (200, {"content-type": HTML}, home),
        "/page2": (200, {"content-type": "text/html"}, _page("Fixture Page Two", '<h1>Two</h1><h2>Sub</h2><a href="/deep/page3?b=2&amp;a=1#fragment">3</a><a href="/page">1</a>')),
        "/deep/page3": (200, {"content-type": "text/html"}, _page("Deep", "<h1>Deep Page</h1>")),
        "/deep/page3?b=2&a=1": (200, {"content-type": "text/html"}, _page("Deep", "<h1>Deep Page</h1>")),
        "/blocked": (200, {"content-type": "text/html"}, _page("Blocked", "<h1>Blocked</h1>")),
        "/redirect": (302, {"location": "/page2"}, b""),
        "/redirect-loop": (302, {"location": "/redirect-loop"}, b""),
        "/retry-after": (429, {"retry-after": "1", "content-type": "text/plain"}, b"slow down"),
        "/unavailable": (503, {"retry-after": "1", "content-type": "text/plain"}, b"unavailable"),
        "/large": (200, {"content-type": "text/html"}, b"x" * (3 * 1024 * 1024)),
        "/gzip": (200, {"content-type": "text/html", "content-encoding": "gzip"}, gzip.compress(_page("Gzip", "<h1>Gzip Page</h1>"), mtime=0)),
    }


CHUNKED_BODY = b"".join(b"%x\r\n%b\r\n" % (len(c), c) for c in (b"<html><body>", b"Hi</body></html>", b""))


def fixture_site(spark: SparkSession, origin: str = "http://site.test") -> DataFrame:
    """url, status_code, headers, body: one row per route."""
    rows = [(origin + path, status, headers, bytearray(body)) for path, (status, headers, body) in routes().items()]
    return spark.createDataFrame(rows, "url string, status_code int, headers map<string,string>, body binary")


SITE = "url string, status_code int, headers map<string,string>, body binary"
