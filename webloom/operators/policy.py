"""Failure classes, retries and back-off as Column expressions."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
RETRYABLE_STATUS = [408, 425, 429, 500, 502, 503, 504]
RETRYABLE_CATEGORIES = [
    "dns_error",
    "connect_timeout",
    "connection_error",
    "read_timeout",
    "total_timeout",
    "server_error",
    "rate_limited",
]
REDIRECT_STATUS = [301, 302, 303, 307, 308]


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def status_category(status: Column | str) -> Column:
    status = _c(status)
    return F.when(status == 429, "rate_limited").when(status >= 500, "server_error").when(status >= 400, "client_error")


def is_redirect(status: Column | str) -> Column:
    return _c(status).isin(REDIRECT_STATUS)


def should_retry(status: Column | str, category: Column | str, retry_count: Column | str, max_retries: int = 2) -> Column:
    again = F.coalesce(_c(status).isin(RETRYABLE_STATUS), F.lit(False)) | F.coalesce(_c(category).isin(RETRYABLE_CATEGORIES), F.lit(False))
    return (_c(retry_count) < max_retries) & again


def retry_after_seconds(value: Column | str, now: Column | None = None) -> Column:
    """Seconds that a Retry-After asks for: a number, or an HTTP date from now on; else null."""
    value = F.trim(_c(value))
    now = F.current_timestamp() if now is None else now
    date = F.regexp_replace(value, "^[A-Za-z]+, ", "")
    date = F.when(date.rlike(r"(GMT|UTC|[+-]\d{4})$"), date).otherwise(F.concat(date, F.lit(" GMT")))
    at = F.coalesce(F.try_to_timestamp(date, F.lit("dd MMM yyyy HH:mm:ss zzz")), F.try_to_timestamp(date, F.lit("dd MMM yyyy HH:mm:ss xx")))
    wait = F.when(at.isNotNull(), F.greatest(F.lit(0.0), F.unix_micros(at) / 1e6 - F.unix_micros(now) / 1e6))
    return F.when(value.rlike("^[0-9]+$"), value.try_cast("double")).otherwise(wait)


def backoff_seconds(retry_count: Column | str, retry_after: Column | str | None = None, base: float = 1.0, most: float = 60.0, jitter: float = 0.0, seed: int = 0) -> Column:
    """Retry-After as it is, or else base * 2**n up to ``most``, with up to ``jitter`` more."""
    delay = F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), _c(retry_count)))
    if jitter:
        delay = delay + F.rand(seed) * jitter
    return delay if retry_after is None else F.coalesce(retry_after_seconds(retry_after), delay)


def pauses_domain(retry_after: Column | str, category: Column | str) -> Column:
    """Whether a failed fetch holds up the whole domain."""
    asked = F.coalesce(_c(retry_after), F.lit("")) != ""
    return asked | F.coalesce(_c(category).isin("rate_limited", "server_error"), F.lit(False))


def effective_delay(min_delay: float, crawl_delay: Column | str) -> Column:
    return F.greatest(F.lit(float(min_delay)), F.coalesce(_c(crawl_delay), F.lit(0.0)))


#: Addresses that are not public: first and last address of each IPv4 block. Fixed values.
PRIVATE_BLOCKS = [
    "0.0.0.0/8",
    "10.0.0.0/8",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "172.16.0.0/12",
    "192.0.0.0/29",
    "192.0.2.0/24",
    "192.168.0.0/16",
    "198.18.0.0/15",
    "198.51.100.0/24",
    "203.0.113.0/24",
    "224.0.0.0/4",
    "240.0.0.0/4",
]


_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"


def _number_v4(ip: Column) -> Column:
    """The address as a number; null for what is no IPv4 address."""
    octets = F.transform(F.split(ip, r"\."), lambda x: x.try_cast("long"))
    return F.when(ip.rlike(rf"^{_OCTET}(\.{_OCTET}){{3}}$"), F.aggregate(octets, F.lit(0).cast("long"), lambda a, x: a * 256 + x))


def is_private_ipv4(ip: Column | str) -> Column:
    """True for private, loopback, link-local, multicast, reserved and unspecified IPv4
    addresses, and for what cannot be parsed."""
    number, inside = _number_v4(_c(ip)), F.lit(False)
    for block in PRIVATE_BLOCKS:
        base, bits = block.split("/")
        first = int.from_bytes(bytes(map(int, base.split("."))), "big")
        inside = inside | number.between(first, first + (1 << (32 - int(bits))) - 1)
    return F.coalesce(inside, F.lit(True))


#: IPv6 blocks that are not public, and those inside them that are. Fixed values.
PRIVATE_BLOCKS_V6 = [
    "::/8",
    "100::/8",
    "200::/7",
    "400::/6",
    "800::/5",
    "1000::/4",
    "2001::/23",
    "2001:db8::/32",
    "2002::/16",
    "4000::/3",
    "6000::/3",
    "8000::/3",
    "a000::/3",
    "c000::/3",
    "e000::/4",
    "f000::/5",
    "f800::/6",
    "fc00::/7",
    "fe00::/9",
    "fe80::/10",
    "ff00::/8",
]
PUBLIC_BLOCKS_V6 = ["2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28"]


def _ranges_v6() -> list[tuple[int, bool]]:
    """Sorted starts of disjoint ranges that cover all addresses, with whether each is blocked."""
    spans = lambda blocks: [(int(n.network_address), int(n.broadcast_address) + 1) for n in map(ipaddress.ip_network, blocks)]
    blocked, open_ = spans(PRIVATE_BLOCKS_V6), spans(PUBLIC_BLOCKS_V6)
    within = lambda at, where: any(a <= at < b for a, b in where)
    out: list[tuple[int, bool]] = []
    for at in sorted({0, *(v for s in blocked + open_ for v in s if v < 1 << 128)}):
        state = within(at, blocked) and not within(at, open_)
        if not out or out[-1][1] != state:
            out.append((at, state))
    return out


def ipv6_halves(ip: Column | str) -> Column:
    """struct<hi,lo> of an IPv6 address, its 128 bits as two longs; null for what is none.

    A zone (after %) is dropped, ``::`` stands for one zero group at least, and the last two groups may
    be written as an IPv4 address.
    """
    text = F.lower(F.regexp_replace(_c(ip), "(?s)%.*$", ""))

    def groups_only(t: Column) -> Column:
        tail = _number_v4(F.regexp_extract(t, r"^.*:([0-9]+\.[0-9.]+)$", 1))
        pair = lambda n: F.concat(F.regexp_extract(t, r"^(.*:)[0-9.]+$", 1), F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(F.lit(0xFFFF)))))
        return _bound(tail, lambda n: F.when(n.isNotNull(), pair(n)).otherwise(t))

    def sides(t: Column) -> Column:
        """All eight groups; an empty array where there are too many or too few."""
        two = F.split(t, "::", 2)
        side = lambda i: F.filter(F.split(F.coalesce(F.get(two, F.lit(i)), F.lit("")), ":", -1), lambda g: F.get(two, F.lit(i)) != "")

        def joined(s: Column) -> Column:
            n, short = F.size(s["a"]) + F.size(s["b"]), F.size(two) == 2
            zeros = F.array_repeat(F.lit("0"), F.greatest(8 - n, F.lit(0)))
            return F.when(F.when(short, n <= 7).otherwise(n == 8), F.concat(s["a"], zeros, s["b"])).otherwise(F.array().cast("array<string>"))

        return _bound(F.struct(side(0).alias("a"), side(1).alias("b")), joined)

    def halves(g: Column) -> Column:
        valid = (F.size(g) == 8) & F.forall(g, lambda x: x.rlike("^[0-9a-f]{1,4}$"))
        number = lambda at: F.aggregate(F.slice(g, at, 4), F.lit(0).cast("long"), lambda n, x: F.shiftleft(n, 16).bitwiseOR(F.conv(x, 16, 10).cast("long")))
        return F.when(valid, F.struct(number(1).alias("hi"), number(5).alias("lo")))

    return _bound(_bound(_bound(text, groups_only), sides), halves)


def _bound(value: Column, f) -> Column:
    """f(value), with value worked out once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _ordered(half: int) -> int:
    """64 bits as a signed long whose order is that of the unsigned number."""
    return half - (1 << 63)


def is_private_ipv6(ip: Column | str) -> Column:
    """Whether an IPv6 address lies in a blocked range, by halving sorted disjoint ranges; those that
    stand for IPv4 addresses do. True for what cannot be parsed."""
    ranges = _ranges_v6()
    starts = F.array(*[F.struct(F.lit(_ordered(a >> 64)).cast("long").alias("hi"), F.lit(_ordered(a & (1 << 64) - 1)).cast("long").alias("lo")) for a, _ in ranges])
    blocked = F.array(*[F.lit(b) for _, b in ranges])
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(ranges).bit_length()))])
    flip = F.lit(-(1 << 63)).cast("long")

    def judged(h: Column) -> Column:
        key = F.struct(h["hi"].bitwiseXOR(flip).alias("hi"), h["lo"].bitwiseXOR(flip).alias("lo"))
        place = lambda k: F.aggregate(steps, F.lit(0), lambda p, step: F.when((p + step <= len(ranges)) & (F.try_element_at(starts, p + step) <= k), p + step).otherwise(p))
        return F.when(h.isNull(), F.lit(True)).otherwise(F.try_element_at(blocked, _bound(key, place)))

    return _bound(ipv6_halves(ip), judged)


def is_blocked_address(ip: Column | str) -> Column:
    """The rule for either kind of address."""
    ip = _c(ip)
    return F.when(F.contains(ip, F.lit(":")), is_private_ipv6(ip)).otherwise(is_private_ipv4(ip))


def public_address(text: str | None) -> bool:
    """For one address at hand: whether it is one of the open network; what is no address is not."""
    try:
        a = ipaddress.ip_address((text or "").split("%")[0])
    except ValueError:
        return False
    return not any(getattr(a, f"is_{kind}") for kind in ("private", "loopback", "link_local", "multicast", "reserved", "unspecified"))
