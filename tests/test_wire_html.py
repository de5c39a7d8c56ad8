import gzip
import zlib

import pytest

from webloom.functions import html as H
from webloom.functions import wire as W
from webloom.sources.fixture import CHUNKED_BODY


def error(f, *args):
    with pytest.raises(W.WireError) as e:
        f(*args)
    return e.value.category


def test_status_line():
    assert W.parse_status_line(b"HTTP/1.1 200 OK") == ("HTTP/1.1", 200, "OK")
    assert W.parse_status_line(b"HTTP/1.0 404") == ("HTTP/1.0", 404, "")
    assert W.parse_status_line(b"HTTP/1.10 200  OK ") == ("HTTP/1.10", 200, "OK")
    for bad in (b"HTTP/1.1 999 X", b"HTTP/1.1 20", b"nope", b"HTTP/1.1  200 OK"):
        assert error(W.parse_status_line, bad) == W.MALFORMED


def test_headers():
    assert W.parse_headers(b"A: 1\r\na: 2\r\nSet-Cookie: x\r\nset-cookie: y") == {"a": "1, 2", "set-cookie": "y"}
    assert W.parse_headers(b"A: 1\r\n\r\nB: 2") == {"a": "1", "b": "2"}
    for bad in (b"bad name: x", b"no colon", b"A: x\ny"):
        assert error(W.parse_headers, bad) == W.MALFORMED


def test_content_length():
    assert W.parse_content_length("5, 5") == 5 == W.parse_content_length("5, 05")
    for bad in ("5, 6", "-1", "x", ""):
        assert error(W.parse_content_length, bad) == W.MALFORMED


def test_chunked():
    assert W.decode_chunked(CHUNKED_BODY) == b"<html><body>Hi</body></html>"
    assert W.decode_chunked(b"4;x=y\r\nWiki\r\n5\r\npedia\r\n0\r\nT: 1\r\n\r\n") == b"Wikipedia"
    reader, whole = W.ChunkedBody(99), b"4;x=y\r\nWiki\r\n0\r\nT: 1\r\n\r\n"
    for i in range(len(whole)):  # a byte at a time
        assert not reader.done
        reader.feed(whole[i : i + 1])
    assert reader.done and reader.close() == b"Wiki"
    for bad in (b"zz\r\n", b"4\r\nWikiXX", b"-4\r\nWiki\r\n0\r\n\r\n", b"", b"1\r\na\r\n0\r\n", b"1\r\na\r\n", b"1\r\na"):
        assert error(W.decode_chunked, bad) == W.MALFORMED
    assert error(W.decode_chunked, CHUNKED_BODY, 5) == W.TOO_LARGE


def test_decompress():
    raw = zlib.compressobj(9, zlib.DEFLATED, -15)
    assert W.decompress(gzip.compress(b"x" * 9), "gzip, br") == b"x" * 9
    assert W.decompress(zlib.compress(b"abc"), "deflate") == b"abc"
    assert W.decompress(raw.compress(b"abc") + raw.flush(), "deflate") == b"abc"
    assert W.decompress(b"p", None) == b"p" == W.decompress(b"p", " identity ")
    assert error(W.decompress, b"p", "br") == W.UNSUPPORTED
    assert error(W.decompress, b"plain text", "gzip") == W.MALFORMED
    assert error(W.decompress, gzip.compress(b"x" * 100), "gzip", 50) == W.TOO_LARGE


def test_framing():
    head = b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\n"
    assert W.parse_response(head + b"abcd")["body"] == b"abc"
    assert W.parse_response(head + b"ab")["error"] == W.MALFORMED
    assert W.parse_response(b"HTTP/1.1 204 No\r\n\r\nxx")["body"] == b""
    both = b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\nTransfer-Encoding: chunked\r\n\r\n"
    assert W.parse_response(both)["error"] == W.MALFORMED
    assert W.parse_response(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: gzip\r\n\r\n")["error"] == W.MALFORMED


def test_request():
    out = W.build_get_request("/x", "h", "ua", {"accept": "*/*", "X-A": "1"})
    assert out == b"GET /x HTTP/1.1\r\nHost: h\r\nUser-Agent: ua\r\nAccept: */*\r\nAccept-Encoding: identity\r\nConnection: close\r\nX-A: 1\r\n\r\n"
    assert error(W.build_get_request, "/x", "h", "ua\r\nX: y") == W.MALFORMED
    assert error(W.build_get_request, "/a b", "h", "ua") == "malformed_url"


DECODED = [
    (b"\xef\xbb\xbfx", "", ("x", "utf-8-sig", None)),
    ("x".encode("utf-16"), "text/html; charset=utf-8", ("x", "utf-16", None)),
    (b"\x93x", "text/html; charset=ISO-8859-1", ("“x", "windows-1252", None)),
    (b"x", "text/html; charset=UTF-8", ("x", "UTF-8", None)),
    (b"\xff", "text/html; charset=utf-8", (None, None, "parse_error")),
    (b"x", "text/html; charset=nope", (None, None, "parse_error")),
    (b'<meta charset="latin1">\xe9', "", ('<meta charset="latin1">é', "windows-1252", None)),
    (b'<meta charset="nope">\xff', "", ('<meta charset="nope">�', "utf-8", None)),
    (b"\xff", "", ("�", "utf-8", None)),
]


@pytest.mark.parametrize(("body", "ct", "want"), DECODED)
def test_decode_html(body, ct, want):
    assert W.decode_html(body, ct) == want


def page(html, url="http://h/d/p"):
    return H.parse_page(html, url)


def test_links():
    got = page('<base href="/b/"><a href="x#f">1</a><area href="/y"><iframe src="z"></iframe><a href="#s"><a href="mailto:m"><a href="x"><a href="http://[bad">')
    assert got["links"] == ["http://h/b/x", "http://h/y", "http://h/b/z"]
    assert page('<a href="one" href="two">')["links"] == ["http://h/d/two"]


def test_malformed_pages_are_rows(monkeypatch):
    got = page("<![foo[bar]]>")
    assert got["error"] == "parse_error" and got["title"] is None
    monkeypatch.setattr(H, "title_of", lambda events: 1 / 0)
    assert page("<p>")["error"] == "internal_parse_error"


def test_meta_charset():
    assert W.meta_charset(b'<META http-equiv="Content-Type" content="text/html; charset=koi8-r">') == "koi8-r"
    assert W.meta_charset(b"<meta name=x><meta charset='utf-8'/>") == "utf-8" and W.meta_charset(b"<p>") is None


def test_title_and_headings():
    assert page("<title> A \n B </title><title>C &lt; D</title>")["title"] == "C < D"
    assert page("<title>Real Title<meta name=x><body><h1>H</h1>")["title"] == "Real Title"
    assert page("<title> </title>")["title"] is None
    assert page("<h1>a <h2>b</h2> c</h1><h3></h3><h4>d &amp; e</h4><h5>open")["headings"] == ["a b c", "d & e"]


def test_description():
    assert page('<meta property="og:description" content="o">')["description"] == "o"
    assert page('<meta name="description" content=" d1 "><meta name="Description" content="d2"><meta property="og:description" content="o">')["description"] == "d2"


def test_parse_html_column(spark):
    df = spark.createDataFrame([("<title>T</title>", "http://x/"), (None, "http://x/")], "html string, url string")
    got = df.select(H.parse_html("html", "url").alias("p")).select("p.title", "p.error").collect()
    assert [tuple(r) for r in got] == [("T", None), (None, "parse_error")]


def test_wire_columns(spark):
    df = spark.createDataFrame([(bytearray(CHUNKED_BODY),), (bytearray(b"zz"),)], "d binary")
    assert [r.c.error for r in df.select(W.chunked("d").alias("c")).collect()] == [None, W.MALFORMED]
    h = spark.sql("SELECT map('A', '1', 'a', '2', 'Cookie', 'c') AS h")
    assert h.select(W.lower_keys("h")).first()[0] == {"a": "1", "cookie": "c"}
    assert h.select(W.header("h", "A")).first()[0] == "1"
    assert set(h.select(W.without_credentials("h")).first()[0]) == {"A", "a"}


def test_chunked_bodies_take_linear_time():
    """2 MiB in chunks of one byte, fed whole and in small pieces."""
    import time

    from webloom.functions import wire as W

    body = b"1\r\nx\r\n" * (2 << 20) + b"0\r\n\r\n"
    for step in (len(body), 1 << 16):
        reader, began = W.ChunkedBody(2 << 20), time.monotonic()
        for i in range(0, len(body), step):
            reader.feed(body[i : i + step])
        assert reader.close() == b"x" * (2 << 20) and time.monotonic() - began < 30
    slow = W.ChunkedBody(100)
    for b in b"3;x=1\r\nabc\r\n2\r\nde\r\n0\r\nT: 1\r\n\r\n":
        slow.feed(bytes([b]))
    assert slow.close() == b"abcde"
