"""URL algebra as Column expressions: everything here stays inside Catalyst.

URLs are cut by one RFC 3986 pattern. A URL that cannot be normalized gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query keys that only track visitors; beside them every key that begins with utm_.
TRACKING_PARAMS = [
    "fbclid",
    "gclid",
    "gbraid",
    "wbraid",
    "msclkid",
    "dclid",
    "yclid",
    "igshid",
    "mc_cid",
    "mc_eid",
]

URL = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:[?]([^#]*))?(?:#(.*))?$"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cleaned(url: Column | str) -> Column:
    """Without blanks at the ends, and without tabs and line ends anywhere."""
    return F.regexp_replace(F.regexp_replace(_c(url), r"^[\s\x00-\x1f]+|\s+$", ""), r"[\t\r\n]", "")


def part(url: Column | str, n: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query, 5 fragment."""
    return F.regexp_extract(_c(url), URL, n)


def _host_port(url: Column) -> Column:
    return F.regexp_replace(part(url, 2), r"(?s)^.*@", "")


def raw_host(url: Column | str) -> Column:
    """Lower-case host as written, '' where there is none."""
    at = _host_port(_c(url))
    return F.lower(F.when(at.startswith("["), F.regexp_extract(at, r"^\[([^\]]*)", 1)).otherwise(F.regexp_extract(at, "^([^:]*)", 1)))


def port_text(url: Column | str) -> Column:
    at = _host_port(_c(url))
    return F.when(at.startswith("["), F.regexp_extract(at, r"\]:(.*)$", 1)).otherwise(F.regexp_extract(at, "^[^:]*:(.*)$", 1))


def ascii_host(host: Column | str) -> Column:
    """IDNA form of a host with other than ASCII characters; unchanged where it has none."""
    host = _c(host)
    return F.when(host.rlike(r"[^\x00-\x7F]"), F.coalesce(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), host), host)).otherwise(host)


def domain(url: Column | str) -> Column:
    """The host that paces requests: lower-case, IDNA; '' where there is none."""
    return ascii_host(raw_host(_c(url)))


def canonical_domain(host: Column | str) -> Column:
    """Without a leading ``www.`` where the rest is still a domain of two labels."""
    host = F.lower(_c(host))
    rest = F.substring(host, 5, 1 << 20)
    return F.when(host.startswith("www.") & F.contains(rest, F.lit(".")), rest).otherwise(host)


def in_scope(url: Column | str, seeds: list[str], stay: bool = True) -> Column:
    """Whether the URL's host is one of the allowed hosts, ``www.`` aside."""
    if not stay:
        return F.lit(True)
    allowed = sorted({x for s in seeds for x in [_canonical(s)] if x})
    return canonical_domain(domain(url)).isin(allowed)


def _canonical(host: str) -> str:
    host = host.strip().lower()
    return host[4:] if host.startswith("www.") and "." in host[4:] else host


def _default_port(scheme: Column) -> Column:
    return F.when(scheme == "http", F.lit(80)).when(scheme == "https", F.lit(443))


def port_number(url: Column | str) -> Column:
    """The port as an integer, null where absent or empty, -1 where it is no port."""
    text = port_text(url)
    number = F.coalesce(F.try_to_number(text, F.lit("9999999999")).cast("long"), F.lit(-1))
    return F.when(text == "", F.lit(None).cast("long")).when(text.rlike("^[0-9]{1,10}$") & (number <= 65535), number).otherwise(F.lit(-1))


def origin(url: Column | str) -> Column:
    """scheme://host:port with the default port filled in; a bad port counts as the default."""
    url = _c(url)
    scheme, port = F.lower(part(url, 1)), port_number(url)
    port = F.coalesce(F.when(port >= 0, port), _default_port(scheme).cast("long"), F.lit(0))
    return F.concat(scheme, F.lit("://"), raw_host(url), F.lit(":"), port.cast("string"))


def same_origin(a: Column | str, b: Column | str) -> Column:
    return origin(a) == origin(b)


def robots_key(url: Column | str) -> Column:
    """The key under which robots rules are kept: an explicit port stays, even a default one."""
    url = _c(url)
    host, port = raw_host(url), port_number(url)
    shown = F.when(F.contains(host, F.lit(":")), F.concat(F.lit("["), host, F.lit("]"))).otherwise(host)
    return F.concat(F.lower(part(url, 1)), F.lit("://"), shown, F.when(port > 0, F.concat(F.lit(":"), port.cast("string"))).otherwise(""))


def robots_target(url: Column | str) -> Column:
    """Path (or /) and query, as written: what robots rules match."""
    url = _c(url)
    path, query = part(url, 3), part(url, 4)
    return F.concat(F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def clean_path(path: Column) -> Column:
    """Without empty and dot segments, a final slash kept, percent-encoded."""
    kept = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    empty = F.array().cast("array<string>")
    climbed = F.aggregate(kept, empty, lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))))
    segments = F.when(F.contains(path, F.lit("..")), climbed).otherwise(kept)
    joined = F.concat(F.lit("/"), F.array_join(segments, "/"))
    slashed = F.when(path.endswith("/") & (joined != "/"), F.concat(joined, F.lit("/"))).otherwise(joined)
    plain = slashed.rlike(r"^[A-Za-z0-9_.~/%:@-]*$")
    out = F.url_encode(slashed)
    for code, char in (("%7E", "~"), ("*", "%2A"), ("+", "%20"), ("%2F", "/"), ("%3A", ":"), ("%40", "@"), ("%25", "%")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return F.when(plain, slashed).otherwise(out)


def _form_decoded(s: Column) -> Column:
    safe = F.regexp_replace(s, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(s.rlike("[%+]"), F.coalesce(F.try_url_decode(safe), s)).otherwise(s)


def _form_encoded(s: Column) -> Column:
    out = F.replace(F.replace(F.url_encode(s), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    return F.when(s.rlike("^[A-Za-z0-9_.~-]*$"), s).otherwise(out)


def query_items(query: Column | str) -> Column:
    """array<struct<k,v>> of the decoded items; only & parts items, empty ones vanish."""
    pieces = F.filter(F.split(_c(query), "&"), lambda x: x != "")
    key = lambda x: F.regexp_extract(x, "(?s)^([^=]*)", 1)
    value = lambda x: F.regexp_extract(x, "(?s)^[^=]*=(.*)$", 1)
    return F.transform(pieces, lambda x: F.struct(_form_decoded(key(x)).alias("k"), _form_decoded(value(x)).alias("v")))


def is_tracking(key: Column) -> Column:
    low = F.lower(key)
    return low.startswith("utm_") | low.isin(TRACKING_PARAMS)


def clean_query(query: Column | str, strip_tracking: bool = True) -> Column:
    """Items without tracking ones, sorted by (key, value), form-encoded."""
    items = query_items(query)
    if strip_tracking:
        items = F.filter(items, lambda x: ~is_tracking(x["k"]))
    return F.array_join(F.transform(F.array_sort(items), lambda x: F.concat(_form_encoded(x["k"]), F.lit("="), _form_encoded(x["v"]))), "&")


def normalize_url(url: Column | str, strip_tracking: bool = True) -> Column:
    """The identity of a URL: null where scheme or host is missing or the port is none."""
    url = cleaned(url)
    scheme, host, port = F.lower(part(url, 1)), domain(url), port_number(url)
    shown = F.when(F.contains(host, F.lit(":")), F.concat(F.lit("["), host, F.lit("]"))).otherwise(host)
    explicit = (port > 0) & ~F.coalesce(port == _default_port(scheme), F.lit(False))
    authority = F.when(explicit, F.concat(shown, F.lit(":"), port.cast("string"))).otherwise(shown)
    path, query = part(url, 3), part(url, 4)
    query = F.when(query == "", "").otherwise(clean_query(query, strip_tracking))
    whole = F.concat(scheme, F.lit("://"), authority, clean_path(F.when(path == "", "/").otherwise(path)), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when((scheme != "") & (host != "") & (F.coalesce(port, F.lit(0)) >= 0), whole)


def url_error(url: Column | str) -> Column:
    """null, or why a URL cannot be fetched: unsupported_scheme, malformed_url."""
    url = cleaned(url)
    scheme = F.lower(part(url, 1))
    return F.when(~scheme.isin("http", "https"), "unsupported_scheme").when((raw_host(url) == "") | (F.coalesce(port_number(url), F.lit(0)) < 0), "malformed_url")


def is_http_url(url: Column | str) -> Column:
    return F.lower(part(_c(url), 1)).isin("http", "https")


def origin_form(url: Column | str) -> Column:
    """Path and query of a request line; null where it would need blanks or control characters."""
    target = robots_target(url)
    return F.when(~target.rlike(r"[\x00\r\n ]"), target)


def host_header(url: Column | str) -> Column:
    """The Host header: IPv6 in brackets, a default port left out."""
    url = _c(url)
    scheme, host, port = F.lower(part(url, 1)), domain(url), port_number(url)
    shown = F.when(F.contains(host, F.lit(":")), F.concat(F.lit("["), host, F.lit("]"))).otherwise(host)
    explicit = (port > 0) & ~F.coalesce(port == _default_port(scheme), F.lit(False))
    return F.when(explicit, F.concat(shown, F.lit(":"), port.cast("string"))).otherwise(shown)


def resolve(base: Column | str, href: Column | str) -> Column:
    """RFC 3986 reference resolution, fragment dropped; '' where the href is only a fragment."""
    base, href = _c(base), F.trim(_c(href))
    scheme, authority, path, query = part(href, 1), part(href, 2), part(href, 3), part(href, 4)
    has_auth = href.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//")
    has_query = href.rlike(r"^[^#]*\?")
    base_path = part(base, 3)
    folder = F.when(base_path == "", "/").otherwise(F.regexp_replace(base_path, "[^/]*$", ""))
    merged = F.when(path.startswith("/"), path).otherwise(F.concat(folder, path))
    new_path = F.when(path == "", base_path).otherwise(_no_dots(merged))
    new_query = F.when(has_query | (path != ""), query).otherwise(part(base, 4))
    whole = lambda s, a, p, q: F.concat(s, F.lit("://"), a, p, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
    opaque = F.concat(F.lower(scheme), F.lit(":"), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    out = F.when((scheme != "") & ~has_auth, opaque)
    out = out.when(has_auth, whole(F.lower(F.when(scheme == "", part(base, 1)).otherwise(scheme)), authority, path, query))
    return out.otherwise(whole(part(base, 1), part(base, 2), new_path, new_query))


def _no_dots(path: Column) -> Column:
    """Dot segments removed as RFC 3986 says; empty segments stay."""
    parts = F.split(F.substring(path, 2, 1 << 20), "/")
    empty = F.array().cast("array<string>")
    tail = path.rlike(r"/\.{1,2}$")
    walked = F.aggregate(parts, empty, lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))))
    joined = F.concat(F.lit("/"), F.array_join(walked, "/"))
    return F.when(~path.rlike(r"/\.{1,2}(/|$)"), path).otherwise(F.when(tail & ~joined.endswith("/"), F.concat(joined, F.lit("/"))).otherwise(joined))
