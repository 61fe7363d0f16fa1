"""Normal form of citation URLs, in expressions; only the encoding of international names runs in Python."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import let

MAX_URL = 2048
MAX_NAME = 253

#: An https URL in one piece: authority, path, query, fragment.
_WHOLE = r"^[hH][tT][tT][pP][sS]://([^/?#]*)([^?#]*)(\?[^#]*)?(?:#.*)?$"
#: Host with an optional port that is empty or 443; no user info.
_AUTHORITY = r"^(\[[0-9a-fA-F:.]+\]|[^\[\]@:]+)(?::0*(?:443)?)?$"
_LABELS = r"^(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)*[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?$"
_HEX = r"0x[0-9a-f]*"
#: Names whose last label is one of these are not public.
_LOCAL = ("localhost", "local")

#: IPv4 ranges that are not global, as first and last address, by the public registry of special-purpose addresses; the last two are multicast and reserved.
_CLOSED_V4 = (
    ("0.0.0.0", "0.255.255.255"), ("10.0.0.0", "10.255.255.255"), ("100.64.0.0", "100.127.255.255"), ("127.0.0.0", "127.255.255.255"), ("169.254.0.0", "169.254.255.255"), ("172.16.0.0", "172.31.255.255"),
    ("192.0.0.0", "192.0.0.8"), ("192.0.0.11", "192.0.0.255"), ("192.0.2.0", "192.0.2.255"), ("192.168.0.0", "192.168.255.255"), ("198.18.0.0", "198.19.255.255"), ("198.51.100.0", "198.51.100.255"), ("203.0.113.0", "203.0.113.255"),
    ("224.0.0.0", "239.255.255.255"), ("240.0.0.0", "255.255.255.255"),
)
#: The same for IPv6, as leading bits and their number.
_CLOSED_V6 = (
    ("0:0:0:0:0:0:0:0", 127), ("64:ff9b:1:0", 48), ("100:0:0:0", 64), ("2001:0", 32), ("2001:2", 48), ("2001:10", 28), ("2001:db8", 32), ("2002", 16), ("3fff:0", 20), ("fc00", 7), ("fe80", 10), ("ff00", 8),
)


def _any(tests) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _address(dotted: str) -> int:
    return sum(int(part) << (24 - 8 * i) for i, part in enumerate(dotted.split(".")))


def _value(part: Column) -> Column:
    """A part of a host as a number (hexadecimal behind 0x, octal behind 0, else decimal), null if it isn't one; beyond 32 bits 2**32."""
    digits = F.regexp_replace(part, "^(?:0x0*|0+(?=.))", "")
    base = F.when(part.rlike(f"^{_HEX}$"), 16).when(part.rlike("^0[0-7]*$"), 8).when(part.rlike("^[1-9][0-9]*$"), 10)
    read = lambda b: F.when(digits == "", 0).when(F.length(digits) > 11, 2**32).otherwise(F.least(F.conv(digits, b, 10).cast("long"), F.lit(2**32)))
    return F.when(base == 16, read(16)).when(base == 8, read(8)).when(base == 10, read(10))


def v4_number(host: Column) -> Column:
    """The 32-bit address a host of one to four numbers stands for, or null: all but the last are bytes, the last fills the rest."""

    def joined(n: Column) -> Column:
        size, last = F.size(n), F.try_element_at(n, F.lit(-1))
        lead = F.slice(n, F.lit(1), F.greatest(size - 1, F.lit(0)))
        room = F.call_function("shiftleft", F.lit(1).cast("long"), 8 * (5 - size))
        fits = (size <= 4) & ~F.exists(n, F.isnull) & F.forall(lead, lambda v: v <= 255) & (last < room)
        high = F.aggregate(F.transform(lead, lambda v, i: F.call_function("shiftleft", v, 24 - 8 * i)), F.lit(0).cast("long"), lambda a, v: a + v)
        return F.when(fits, high + last)

    return F.when(F.length(host) > 0, let(F.transform(F.split(F.regexp_replace(host, r"\.$", ""), r"\."), _value), joined))


def _open_v4(number: Column) -> Column:
    return ~_any(number.between(_address(a), _address(b)) for a, b in _CLOSED_V4)


def _dotted(number: Column) -> Column:
    return F.concat_ws(".", *[(F.shiftright(number, 24 - 8 * i) % 256).cast("string") for i in range(4)])


def v6_groups(host: Column) -> Column:
    """The eight 16-bit groups of an IPv6 address, or null."""
    tail = F.regexp_extract(host, r"([0-9]{1,3}(?:\.[0-9]{1,3}){3})$", 1)
    four = v4_number(tail)
    pair = F.concat_ws(":", F.lower(F.hex(F.shiftright(four, 16))), F.lower(F.hex(four % 65536)))
    plain = F.when(tail == "", host).when(four.isNotNull() & ~tail.rlike(r"(^|\.)0[0-9]"), F.concat(F.regexp_replace(host, r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}$", ""), pair))
    groups = lambda side: F.filter(F.split(side, ":"), lambda g: g != "")

    def filled(sides: Column) -> Column:
        left, right = groups(F.get(sides, 0)), groups(F.coalesce(F.get(sides, 1), F.lit("")))
        gap = 8 - F.size(left) - F.size(right)
        all_ = F.when((F.size(sides) == 1) & (gap == 0), left).when((F.size(sides) == 2) & (gap >= 1), F.concat(left, F.array_repeat(F.lit("0"), gap), right))
        return F.transform(all_, lambda g: F.conv(g, 16, 10).cast("int"))

    shape = r"^(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4})*)?(?:::(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4})*)?)?$"
    return let(plain, lambda p: F.when((p != "") & p.rlike(shape), let(F.split(p, "::", -1), filled)))


def _open_v6(groups: Column) -> Column:
    def leads(bits: str, length: int) -> Column:
        tests = []
        for i, part in enumerate(bits.split(":")):
            own = min(16, length - 16 * i)
            if own > 0:
                tests.append(F.shiftright(F.get(groups, i), 16 - own) == (int(part, 16) >> (16 - own)))
        for i in range(len(bits.split(":")), -(-length // 16)):
            own = min(16, length - 16 * i)
            tests.append(F.shiftright(F.get(groups, i), 16 - own) == 0)
        return reduce(lambda a, b: a & b, tests)

    mapped = F.forall(F.slice(groups, 1, 5), lambda g: g == 0) & (F.get(groups, 5) == 65535)
    inner = F.get(groups, 6).cast("long") * 65536 + F.get(groups, 7)
    return F.when(mapped, _open_v4(inner)).otherwise(~_any(leads(b, n) for b, n in _CLOSED_V6))


def _shortest_v6(groups: Column) -> Column:
    """Lower-case hexadecimal with the longest, then first, run of two or more zero groups left out."""
    runs = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.struct(
        F.coalesce(F.array_min(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda j: (j >= i) & (F.get(groups, j) != 0))), F.lit(8)).alias("end"), i.alias("start")))
    best = F.array_max(F.transform(runs, lambda r: F.struct((r["end"] - r["start"]).alias("n"), (-r["start"]).alias("back"))))
    text = lambda part: F.array_join(F.transform(part, lambda g: F.lower(F.hex(g))), ":")

    def cut(b: Column) -> Column:
        left, right = F.slice(groups, F.lit(1), -b["back"]), F.slice(groups, -b["back"] + b["n"] + 1, F.lit(8))
        return F.when(b["n"] >= 2, F.concat(text(left), F.lit("::"), text(right))).otherwise(text(groups))

    return let(best, cut)


@F.pandas_udf(T.StringType())
def ascii_name(hosts: pd.Series) -> pd.Series:
    """International names in their ASCII form, null where there is none."""

    def encoded(host):
        try:
            return None if host is None else host.encode("idna").decode("ascii")
        except UnicodeError:
            return None

    return hosts.map(encoded)


def public_host(host: Column) -> Column:
    """The host as a citation URL writes it, or null: public names of valid labels, and global addresses in their shortest form.

    Browsers read a host whose last label is a number as an IPv4 address; such a host
    is one, in any notation, or is refused.
    """
    international = host.rlike(r"[^\x00-\x7F]")
    name = F.regexp_replace(F.lower(F.when(international, ascii_name(F.when(international, host))).otherwise(host)), r"\.$", "")

    def judged(h: Column) -> Column:
        last = F.try_element_at(F.split(h, r"\."), F.lit(-1))
        numeric = last.rlike(f"^(?:[0-9]+|{_HEX})$")
        six = let(v6_groups(F.regexp_replace(h, r"^\[|\]$", "")), lambda g: F.when(g.isNotNull() & _open_v6(g), F.concat(F.lit("["), _shortest_v6(g), F.lit("]"))))
        four = let(v4_number(h), lambda n: F.when(n.isNotNull() & _open_v4(n), _dotted(n)))
        plain = h.rlike(_LABELS) & (F.length(h) <= MAX_NAME) & ~last.isin(*_LOCAL)
        return F.when(F.contains(h, F.lit(":")), six).when(numeric, four).when(plain, h)

    return let(name, judged)


def normalize(url: Column) -> Column:
    """Normal form of a citation URL, or null.

    https only, no user info, port 443 or none, a public host in ASCII (``public_host``),
    an empty path as ``/``, query kept, fragment dropped, at most ``MAX_URL`` characters before
    and after, whole escapes only, no control characters or backslashes. Blanks at the ends go.
    """
    fine = (F.length(url) <= MAX_URL) & ~url.rlike(r"[\x00-\x1F\x7F\\]") & ~url.rlike("%(?![0-9A-Fa-f]{2})")

    def rebuilt(u: Column) -> Column:
        part = lambda k: F.regexp_extract(u, _WHOLE, k)
        host = public_host(F.nullif(F.regexp_extract(part(1), _AUTHORITY, 1), F.lit("")))
        query = F.when(part(3) == "?", "").otherwise(part(3))
        return F.concat(F.lit("https://"), host, F.when(part(2) == "", "/").otherwise(part(2)), query)

    out = rebuilt(F.regexp_replace(F.when(fine, url), "^ +| +$", ""))
    return F.when(F.length(out) <= MAX_URL, out)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#:]+)", 1))


def label(title: Column, url: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(title), F.lit("")), host_of(url))


def is_public_host(host: Column | str) -> Column:
    """Whether a host is a valid public name or address."""
    return public_host(F.col(host) if isinstance(host, str) else host).isNotNull()
