"""The clients against small servers on loopback."""

import contextlib
import gzip
import socket
import threading
import time

import pytest

from webloom.sources import live
from webloom.sources.fetch import make_fetcher
from webloom.sources.live import Limits, fetch_url

PAGE = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nhello\r\n0\r\n\r\n"
SENT: list[bytes] = []


def _body(data, *fields):
    return b"\r\n".join([b"HTTP/1.1 200 OK", b"Content-Length: %d" % len(data), *fields, b"", data])


@pytest.fixture(scope="module")
def server():
    """Answers by path; /slow sends its head and no more."""

    def to(where):
        return b"HTTP/1.1 302 Found\r\nLocation: " + where + b"\r\nContent-Length: 0\r\n\r\n"

    sock = socket.create_server(("127.0.0.1", 0))
    base = b"http://127.0.0.1:%d" % sock.getsockname()[1]
    other = b"http://localhost:%d" % sock.getsockname()[1]
    answers = {
        b"/page": PAGE, b"/gzip": _body(gzip.compress(b"zipped"), b"Content-Encoding: gzip"), b"/large": _body(b"x" * 5000), b"/short": _body(b"x" * 50)[:-10],
        b"/to": to(b"/page"), b"/loop": to(b"/loop"), b"/ftp": to(b"ftp://x/"), b"/other": to(other + b"/page"), b"/bad": b"what is this\r\n\r\n", b"/busy": b"HTTP/1.1 503 Busy\r\nRetry-After: 1\r\nContent-Length: 0\r\n\r\n",
        **{b"/n%d" % i: to(b"/n%d" % (i + 1)) for i in range(9)},
    }

    def serve():
        while True:
            try:
                link, _ = sock.accept()
            except OSError:
                return
            threading.Thread(target=answer, args=(link,), daemon=True).start()

    def answer(link):
        with contextlib.closing(link):
            data = b""
            while b"\r\n\r\n" not in data:
                piece = link.recv(4096)
                if not piece:
                    return
                data += piece
            SENT.append(data)
            path = data.split(b" ")[1]
            if path == b"/slow":
                link.sendall(b"HTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\n")
                time.sleep(2)
            else:
                link.sendall(answers.get(path, b"HTTP/1.1 404 No\r\nContent-Length: 0\r\n\r\n"))

    threading.Thread(target=serve, daemon=True).start()
    yield base.decode()
    sock.close()


@pytest.mark.parametrize("client", ["socket", "library"])
def test_answers(server, client):
    get = lambda path, **limits: fetch_url(server + path, client, Limits(**limits))
    row = get("/page#f")
    assert (row["status_code"], bytes(row["body"]), row["error_category"]) == (200, b"hello", None)
    assert row["transport"] == client and row["timing"]["total"] > 0
    assert bytes(get("/gzip")["body"]) == b"zipped" and get("/none")["status_code"] == 404
    assert get("/large", max_bytes=100)["error_category"] == "response_too_large"
    assert get("/short")["error_category"] == "malformed_response" == get("/bad")["error_category"]
    assert fetch_url("ftp://x/", client)["error_category"] == "unsupported_scheme"
    assert fetch_url("http:///x", client)["error_category"] == "malformed_url"
    assert fetch_url("http://127.0.0.1:1/", client)["error_category"] == "connection_error"


@pytest.mark.parametrize("client", ["socket", "library"])
def test_redirects(server, client):
    get = lambda path, **limits: fetch_url(server + path, client, Limits(**limits))
    row = get("/to")
    assert row["final_url"] == server + "/page" and [h["status_code"] for h in row["redirects"]] == [302]
    assert (get("/loop")["error_category"], len(get("/loop")["redirects"])) == ("redirect_loop", 1)
    assert get("/ftp")["error_category"] == "unsupported_redirect"
    assert get("/n0")["error_category"] == "too_many_redirects" and get("/n0", redirect_limit=9)["status_code"] == 404


def test_deadline(server):
    began = time.monotonic()
    assert fetch_url(server + "/slow", "socket", Limits(total_timeout=0.5))["error_category"] in ("total_timeout", "read_timeout")
    assert time.monotonic() - began < 1.5


def test_credentials_stay_with_their_origin(server):
    limits = Limits(headers=(("Authorization", "secret"), ("X-Other", "1")))
    del SENT[:]
    fetch_url(server + "/to", "socket", limits)
    assert all(b"secret" in x for x in SENT) and len(SENT) == 2
    del SENT[:]
    fetch_url(server + "/other", "socket", limits)
    assert b"secret" in SENT[0] and b"secret" not in SENT[1] and b"X-Other" in SENT[1]


def test_blocked_addresses(server):
    assert fetch_url(server + "/page", "socket", Limits(block_private_addresses=True))["error_category"] == "blocked_address"
    assert fetch_url(server + "/page", "library", Limits(block_private_addresses=True))["error_category"] == "unsupported_option"


def test_names(server, monkeypatch):
    assert make_fetcher(" Raw_Socket ", total_timeout=3.0) and make_fetcher("library")
    monkeypatch.setattr(live.socket, "getaddrinfo", lambda *a, **k: (_ for _ in ()).throw(socket.gaierror("no")))
    assert fetch_url("http://nowhere.test/", "socket")["error_category"] == "dns_error"


def test_live_crawl(spark, server):
    from pyspark.sql import functions as F

    from webloom.plans.crawl import crawl
    from webloom.schema import CrawlOptions

    seeds = spark.createDataFrame([(server + "/busy", 1)], "url string, order int")
    out = crawl(spark, "socket", server + "/page", CrawlOptions(max_pages=5, retry_count=1, min_delay_seconds=0.0), more_seeds=seeds)
    assert [(r.status_code, r.transport) for r in out.pages.collect()] == [(200, "socket")]
    assert [(r.category, r.retry_count) for r in out.failures.select(F.col("category"), "retry_count").collect()] == [("server_error", 1)]


def test_pacing_holds_over_levels_and_retries(spark):
    """A delay holds from a level to the next, a Retry-After from a pass to the next, and other domains go on."""
    from webloom.plans.crawl import crawl
    from webloom.schema import CrawlOptions

    seen, sock = [], socket.create_server(("127.0.0.1", 0))
    port = sock.getsockname()[1]

    def serve():
        while True:
            try:
                link, _ = sock.accept()
            except OSError:
                return
            with contextlib.closing(link):
                data = b""
                while b"\r\n\r\n" not in data:
                    data += link.recv(4096)
                path = data.split(b" ")[1].decode()
                busy = path == "/b" and not any(p == "/b" for _, p in seen)
                seen.append((time.time(), path))
                html = b'<title>t</title><a href="/b">b</a>' if path == "/a" else b"<title>t</title>"
                head = b"HTTP/1.1 429 Busy\r\nRetry-After: 9\r\n" if busy else b"HTTP/1.1 200 OK\r\n"
                link.sendall(head + b"Content-Type: text/html\r\nContent-Length: %d\r\n\r\n" % len(html) + html)

    threading.Thread(target=serve, daemon=True).start()
    with contextlib.closing(sock):
        o = CrawlOptions(max_pages=5, max_depth=1, retry_count=1, min_delay_seconds=7.0, obey_robots=False)
        out = crawl(spark, "socket", f"http://127.0.0.1:{port}/a", o)
        assert sorted(r.status for r in out.frontier.collect()) == ["fetched", "fetched"]
    at = [t for t, _ in seen]
    assert [p for _, p in seen] == ["/a", "/b", "/b"] and at[1] - at[0] >= 6.9 and at[2] - at[1] >= 8.9


def test_domains_take_turns(spark):
    """Two domains of one task are fetched side by side: the second does not wait for the first's delays."""
    from pyspark.sql import functions as F

    from webloom.sources.fetch import asked_pause, fetch_paced

    rows = [(f"ftp://{d}/{i}", d, i, 0.6, None, None) for d in "ab" for i in range(4)]
    df = spark.createDataFrame(rows, "url string, domain string, rank long, delay double, free_at double, due double").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = fetch_paced(df, "socket", Limits()).select("domain", F.col("free_at")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
    ends = {d: sorted(r.free_at for r in got if r.domain == d) for d in "ab"}
    assert len(got) == 8 and all(b - a >= 0.59 for e in ends.values() for a, b in zip(e, e[1:]))
    assert max(r.free_at for r in got) - min(r.free_at for r in got) < 3.0  # four of each: 1.8 seconds
    assert asked_pause("120", 0.0) == 120.0 and asked_pause("Thu, 01 Jan 1970 00:01:00 GMT", 10.0) == 50.0
    assert asked_pause("soon", 0.0) == asked_pause(None, 0.0) == asked_pause("Thu, 01 Jan 1970 00:00:00 GMT", 10.0) == 0.0
