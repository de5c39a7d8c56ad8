"""Live fetches of one URL: a client on plain sockets and one on the standard library's HTTP client.

Both follow redirects by the same walk, under one deadline, and give rows of FETCH: every failure
is a category. Credentials stay with the origin that they were given for.
"""

from __future__ import annotations

import contextlib
import dataclasses
import functools
import http.client
import socket
import ssl
import time
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as FutureTimeout
from urllib.parse import urldefrag, urljoin, urlsplit

from ..functions import wire as W
from ..operators.policy import REDIRECT_STATUS, public_address
from ..schema import FETCH_COLUMNS

PHASES = ("dns", "connect", "tls", "request", "first_byte", "download", "total")
# Headers that do not go to another origin.
CREDENTIALS = ("authorization", "cookie", "proxy-authorization")


class FetchError(Exception):
    def __init__(self, category: str, message: str = ""):
        super().__init__(message or category)
        self.category = category


@dataclasses.dataclass(frozen=True)
class Limits:
    connect_timeout: float = 5.0
    read_timeout: float = 10.0
    total_timeout: float = 30.0
    max_bytes: int = 2 * 1024 * 1024
    redirect_limit: int = 5
    user_agent: str = "webloom/1.0"
    block_private_addresses: bool = False
    headers: tuple[tuple[str, str], ...] = ()


class Clock:
    """The total deadline of a fetch, and the time that its phases take."""

    def __init__(self, seconds: float):
        self.end = time.monotonic() + seconds
        self.began = self.last = time.monotonic()
        self.took = dict.fromkeys(PHASES, 0.0)

    def left(self, most: float) -> float:
        """How long the next wait may be."""
        rest = self.end - time.monotonic()
        if rest <= 0:
            raise FetchError("total_timeout", "the total time is over")
        return min(most, rest)

    def mark(self, phase: str) -> None:
        now = time.monotonic()
        self.took[phase] += now - self.last
        self.took["total"], self.last = now - self.began, now


@contextlib.contextmanager
def categories():
    """Exceptions of the network as FetchErrors."""
    try:
        yield
    except FetchError:
        raise
    except W.WireError as e:
        raise FetchError(e.category) from e
    except socket.gaierror as e:
        raise FetchError("dns_error", str(e)) from e
    except ssl.SSLError as e:
        raise FetchError("tls_error", str(e)) from e
    except TimeoutError as e:
        raise FetchError("read_timeout", str(e)) from e
    except (http.client.HTTPException, EOFError) as e:
        raise FetchError(W.MALFORMED, repr(e)) from e
    except OSError as e:
        raise FetchError("connection_error", str(e)) from e
    except (ValueError, UnicodeError) as e:
        raise FetchError("malformed_url", str(e)) from e


def parts_of(url: str):
    """(scheme, host, port, target), or the category of what is wrong with the URL."""
    cut = urlsplit(urldefrag(url).url)
    if cut.scheme not in ("http", "https"):
        raise FetchError("unsupported_scheme", cut.scheme)
    if not cut.hostname:
        raise FetchError("malformed_url", "no host")
    port = cut.port or {"http": 80, "https": 443}[cut.scheme]
    return cut.scheme, cut.hostname, port, (cut.path or "/") + (f"?{cut.query}" if cut.query else "")


@functools.cache
def _resolvers() -> ThreadPoolExecutor:
    return ThreadPoolExecutor(4, "resolve")


def addresses(host: str, port: int, limits: Limits, clock: Clock) -> list:
    """What a name stands for, within the time there is; only public ones where that is asked for."""
    try:
        found = _resolvers().submit(socket.getaddrinfo, host, port, type=socket.SOCK_STREAM).result(clock.left(limits.connect_timeout))
    except FutureTimeout:
        raise FetchError("dns_error", "the name took too long") from None
    if limits.block_private_addresses:
        found = [x for x in found if public_address(x[4][0])]
        if not found:
            raise FetchError("blocked_address", f"{host} is not public")
    if not found:
        raise FetchError("dns_error", f"no address for {host}")
    return found


def _socket_to(found: list, limits: Limits, clock: Clock) -> socket.socket:
    """The first address that answers; those that do not are closed, whatever ends the try."""
    last = "no address answers", "connection_error"
    for family, kind, proto, _, address in found:
        with contextlib.ExitStack() as undo:
            sock = socket.socket(family, kind, proto)
            undo.callback(sock.close)
            sock.settimeout(clock.left(limits.connect_timeout))
            try:
                sock.connect(address)
            except OSError as e:
                last = str(e), "connect_timeout" if isinstance(e, TimeoutError) else "connection_error"
                continue
            undo.pop_all()
            return sock
    raise FetchError(last[1], last[0])


def connected(host: str, port: int, secure: bool, limits: Limits, clock: Clock) -> socket.socket:
    found = addresses(host, port, limits, clock)
    clock.mark("dns")
    with contextlib.ExitStack() as undo:
        sock = _socket_to(found, limits, clock)
        undo.callback(sock.close)
        clock.mark("connect")
        if secure:
            context = ssl.create_default_context()
            context.minimum_version = ssl.TLSVersion.TLSv1_2
            sock.settimeout(clock.left(limits.connect_timeout))
            sock = context.wrap_socket(sock, server_hostname=host)
            clock.mark("tls")
        undo.pop_all()
        return sock


def host_field(scheme: str, host: str, port: int) -> str:
    shown = f"[{host}]" if ":" in host else host
    return shown if port == {"http": 80, "https": 443}[scheme] else f"{shown}:{port}"


def by_socket(url: str, headers: dict[str, str], limits: Limits, clock: Clock) -> dict:
    """One exchange over a socket of our own."""
    scheme, host, port, target = parts_of(url)
    with contextlib.closing(connected(host, port, scheme == "https", limits, clock)) as sock:
        sock.settimeout(clock.left(limits.read_timeout))
        sock.sendall(W.build_get_request(target, host_field(scheme, host, port), limits.user_agent, headers))
        clock.mark("request")

        def more() -> bytes:
            sock.settimeout(clock.left(limits.read_timeout))
            return sock.recv(65536)

        data = b""
        while b"\r\n\r\n" not in data:
            if len(data) > W.MAX_HEADER_BYTES:
                raise FetchError(W.TOO_LARGE, "head")
            piece = more()
            if not data:
                clock.mark("first_byte")
            if not piece:
                break
            data += piece
        head, rest = W.split_head(data)
        line, _, block = head.partition(b"\r\n")
        _, status, _ = W.parse_status_line(line)
        fields = W.parse_headers(block)
        reader = W.body_reader(status, fields, limits.max_bytes)
        reader.feed(rest)
        while not reader.done:
            piece = more()
            if not piece:
                break
            reader.feed(piece)
        body = reader.close()
    clock.mark("download")
    return {"status_code": status, "headers": fields, "body": W.decompress(body, fields.get("content-encoding"), limits.max_bytes)}


def by_library(url: str, headers: dict[str, str], limits: Limits, clock: Clock) -> dict:
    """One exchange by http.client, on a connection that is made and checked here."""
    if limits.block_private_addresses:
        raise FetchError("unsupported_option", "this client cannot check addresses; use the socket one")
    scheme, host, port, target = parts_of(url)
    kind = http.client.HTTPSConnection if scheme == "https" else http.client.HTTPConnection
    link = kind(host, port, timeout=clock.left(min(limits.connect_timeout, limits.read_timeout)))
    with contextlib.closing(link):
        link.request("GET", target, headers={"User-Agent": limits.user_agent, "Accept-Encoding": "identity"} | headers)
        clock.mark("request")
        answer = link.getresponse()
        clock.mark("first_byte")
        fields = W.parse_headers("\r\n".join(f"{k}: {v}" for k, v in answer.getheaders()).encode("latin-1"))
        declared = W.parse_content_length(fields["content-length"]) if "content-length" in fields and "transfer-encoding" not in fields else None
        if declared is not None and declared > limits.max_bytes:
            raise FetchError(W.TOO_LARGE)
        parts, size = [], 0
        while piece := answer.read(65536):
            clock.left(limits.read_timeout)
            parts.append(piece)
            size += len(piece)
            if size > limits.max_bytes:
                raise FetchError(W.TOO_LARGE)
        if declared is not None and size < declared and answer.status not in (204, 304):
            raise FetchError(W.MALFORMED, "cut short")
    clock.mark("download")
    return {"status_code": answer.status, "headers": fields, "body": W.decompress(b"".join(parts), fields.get("content-encoding"), limits.max_bytes)}


def origin_of(url: str) -> tuple:
    cut = urlsplit(url)
    return cut.scheme, cut.hostname, cut.port or {"http": 80, "https": 443}.get(cut.scheme)


CLIENTS = {"socket": by_socket, "library": by_library}
# Other names of the clients.
ALIASES = {"raw_socket": "socket", "urllib": "library"}


def fetched_by(fetch: Callable[[str, Limits], Mapping], url: str, limits: Limits) -> dict:
    """A row of FETCH by a fetch function of the caller's: (url, limits) to a mapping with some of FETCH's
    fields. What it leaves out has a default, header names are lower-cased, a body above the limit and
    exceptions are error categories; redirects and encodings are its own to follow and undo."""
    clock = Clock(limits.total_timeout)
    row = dict.fromkeys(FETCH_COLUMNS) | {"url": url, "final_url": url, "redirects": [], "headers": {}, "transport": getattr(fetch, "__name__", "injected")}
    try:
        with categories():
            got = {k: v for k, v in dict(fetch(url, limits)).items() if v is not None}
        if unknown := got.keys() - row.keys():
            raise FetchError("internal_fetch_error", f"no such fields: {sorted(unknown)}")
        if len(got.get("body") or b"") > limits.max_bytes:
            raise FetchError(W.TOO_LARGE)
        row |= got | {"url": url, "headers": {k.lower(): v for k, v in got.get("headers", {}).items()}}
        if row["status_code"] is None and row["error_category"] is None:
            raise FetchError("internal_fetch_error", "neither a status nor an error")
    except FetchError as e:
        row |= {"status_code": None, "body": None, "error_category": e.category, "error_message": str(e)}
    except Exception as e:  # a URL must not end the job
        row |= {"error_category": "internal_fetch_error", "error_message": repr(e)}
    clock.mark("download")
    return {"timing": clock.took} | {k: v for k, v in row.items() if k != "timing" or v is not None}


def fetch_url(url: str, client: str | Callable[[str, Limits], Mapping] = "socket", limits: Limits = Limits()) -> dict:
    """A row of FETCH for one URL, after its redirects."""
    if callable(client):
        return fetched_by(client, url, limits)
    clock, once = Clock(limits.total_timeout), CLIENTS[client]
    row = dict.fromkeys(FETCH_COLUMNS) | {"url": url, "final_url": url, "redirects": [], "headers": {}, "transport": client}
    headers, at = dict(limits.headers), url
    try:
        while True:
            with categories():
                got = once(at, headers, limits, clock)
            row |= got | {"final_url": at}
            to = got["headers"].get("location")
            if got["status_code"] not in REDIRECT_STATUS or not to:
                break
            row["redirects"].append({"url": at, "status_code": got["status_code"], "location": to})
            with categories():
                after = urljoin(at, to)
            before, at = at, after
            if urlsplit(at).scheme not in ("http", "https"):
                raise FetchError("unsupported_redirect", at)
            if at in {h["url"] for h in row["redirects"]}:
                raise FetchError("redirect_loop", at)
            if len(row["redirects"]) > limits.redirect_limit:
                raise FetchError("too_many_redirects", at)
            if origin_of(at) != origin_of(before):
                headers = {k: v for k, v in headers.items() if k.lower() not in CREDENTIALS}
    except FetchError as e:
        row |= {"final_url": at, "body": None, "error_category": e.category, "error_message": str(e)}
    return row | {"timing": clock.took}

