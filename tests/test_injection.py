"""A crawl with the caller's own fetch function and parser."""

from pyspark.sql import functions as F

from webloom.functions import html as H
from webloom.plans.crawl import crawl
from webloom.schema import CrawlOptions
from webloom.sources.live import Limits, fetch_url


def test_crawl_with_fetch_and_parser(spark):
    def fetch_tree(url, limits):
        """Page n links to 2n + 1 and 2n + 2; 4 has no server, 5 breaks the function, 6 is too large."""
        if url.endswith("/robots.txt"):
            return {"status_code": 200, "headers": {"Content-Type": "text/plain"}, "body": b"User-agent: *\nDisallow: /3\n"}
        n = int(url.rsplit("/", 1)[1])
        if n == 4:
            raise ConnectionRefusedError("no server")
        if n == 5:
            raise KeyError(n)
        body = b"x" * (limits.max_bytes + 1) if n == 6 else f"{n};/{2 * n + 1};/{2 * n + 2}".encode()
        return {"status_code": 200, "headers": {"Content-Type": "text/plain"}, "body": body}

    def parse_lines(body, url, content_type):
        title, *links = body.decode().split(";")
        return {"title": title, "links": links}

    o = CrawlOptions(max_depth=2, retry_count=1, min_delay_seconds=0.0, allowed_content_types=("text/plain",), max_response_bytes=100)
    out = crawl(spark, fetch_tree, "http://t.test/0", o, parse=parse_lines)
    pages = {r.normalized_url: r for r in out.pages.collect()}
    assert {u: (r.title, r.depth, r.links, r.transport) for u, r in pages.items()} == {
        f"http://t.test/{n}": (str(n), d, [f"http://t.test/{2 * n + 1}", f"http://t.test/{2 * n + 2}"], "fetch_tree") for n, d in ((0, 0), (1, 1), (2, 1))
    }
    wrong = {r.normalized_url[-1]: r.category for r in out.failures.collect()}
    assert wrong == {"3": "robots_disallowed", "4": "connection_error", "5": "internal_fetch_error", "6": "response_too_large"}


def test_parser_errors_are_values(spark):
    def parse(body, url, content_type):
        return {b"raise": lambda: 1 / 0, b"odd": lambda: {"colour": 1}, b"none": lambda: {"title": None, "links": None}, b"said": lambda: {"error": "parse_error"}}[body]()

    rows = [(bytearray(b), "http://h/") for b in (b"raise", b"odd", b"none", b"said")] + [(None, None)]
    df = spark.createDataFrame(rows, "body binary, url string")
    got = df.select("body", H.parsed_by(parse, "body", "url", F.lit("")).alias("p")).collect()
    errors = {None if r.body is None else bytes(r.body): r.p.error for r in got}
    assert errors == {b"raise": "internal_parse_error", b"odd": "internal_parse_error", b"none": None, b"said": "parse_error", None: "parse_error"}
    assert [r.p.links for r in got if r.body == b"none"] == [[]]


def test_fetch_function_fields():
    assert fetch_url("http://h/", lambda u, limits: {"status": 200})["error_category"] == "internal_fetch_error"
    assert fetch_url("http://h/", lambda u, limits: {})["error_category"] == "internal_fetch_error"
    row = fetch_url("http://h/", lambda u, limits: {"status_code": 404, "headers": {"X-A": "b"}}, Limits())
    assert (row["status_code"], row["headers"], row["error_category"], row["final_url"], row["redirects"]) == (404, {"x-a": "b"}, None, "http://h/", [])
