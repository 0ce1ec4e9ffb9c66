"""URL scalars and guards as Columns."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from headlight.functions.lexicons import STATUS_ERRORS, UNSAFE_RANGES

#: Scheme, host, port and path; user names before the host are passed over.
URL = r"^\s*(?i)(https?)://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^:/?#\s]+)(?::([0-9]*))?(?=[/?#]|\s*$)([^?#]*)"


def normalize_url(c: Column) -> Column:
    """Origin (no user name, no default port) and path, lower-cased, without slashes at the end; a text that is no URL is itself, so treated.

    Paths are not re-encoded and their dot segments stay.
    """
    part = lambda i: F.lower(F.regexp_extract(c, URL, i))
    usual = ((part(1) == "http") & (part(3) == "80")) | ((part(1) == "https") & (part(3) == "443")) | (part(3) == "")
    parsed = F.concat(part(1), F.lit("://"), part(2), F.when(usual, "").otherwise(F.concat(F.lit(":"), part(3))), F.trim(part(4)))
    return F.regexp_replace(F.when(c.rlike(URL), parsed).otherwise(F.lower(c)), "/+$", "")


def host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, URL, 2))


def netloc(c: Column) -> Column:
    """All between the slashes and the path, user name and port too."""
    return F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def domain(c: Column) -> Column:
    """The second engine's source: the netloc without any `www.` in it."""
    return F.replace(netloc(c), F.lit("www."), F.lit(""))


def scheme_allowed(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^(?i)https?://"), F.lit(False))


def host_blocked(h: Column) -> Column:
    return h.rlike(r"^(localhost|.*\.localhost|.*\.local|metadata\.google\.internal)$")


def ipv4_number(ip: Column) -> Column:
    parts = F.split(ip, r"\.")
    value = sum((parts[i].cast("long") * (256 ** (3 - i)) for i in range(4)), F.lit(0))
    return F.when(ip.rlike(r"^((25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(\.|$)){4}$") & ~ip.endswith("."), value)


def ipv4_range(ip: Column) -> Column:
    """The name of the unsafe range that an IPv4 address is in, or null; native."""
    n, out = ipv4_number(ip), F.lit(None).cast("string")
    for name, nets in reversed(UNSAFE_RANGES.items()):
        for x in map(ipaddress.ip_network, nets.split()):
            if x.version == 4:
                out = F.when(n.between(int(x.network_address), int(x.broadcast_address)), name).otherwise(out)
    return out


def ipv4_unsafe(ip: Column) -> Column:
    return ipv4_range(ip).isNotNull()


@F.pandas_udf(StringType())
def address_range(ips: pd.Series) -> pd.Series:
    """The first engine's class of any address: an unsafe range's name, `ok`, or `invalid`; IPv4 written as IPv6 counts as IPv4."""
    nets = [(ipaddress.ip_network(x), name) for name, xs in UNSAFE_RANGES.items() for x in xs.split()]

    def one(x: str | None) -> str:
        try:
            ip = ipaddress.ip_address(x)
        except ValueError:
            return "invalid"
        ip = getattr(ip, "ipv4_mapped", None) or ip
        return next((name for net, name in nets if net.version == ip.version and ip in net), "ok")

    return ips.map(one, na_action=None)


@F.pandas_udf(BooleanType())
def ip_public(ips: pd.Series) -> pd.Series:
    """For any address, IPv6 too: neither private, loopback, link-local, reserved, multicast nor unspecified; null if none."""

    def one(x: str | None) -> bool | None:
        try:
            ip = ipaddress.ip_address(x)
        except ValueError:
            return None
        ip = getattr(ip, "ipv4_mapped", None) or ip
        return not (ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved or ip.is_multicast or ip.is_unspecified)

    return ips.map(one)


def all_public(ips: Column) -> Column:
    """Every resolved address (an array of flags) is public, and there is one."""
    return (F.size(ips) > 0) & F.forall(ips, lambda x: F.coalesce(x, F.lit(False)))


def content_allowed(content_type: Column) -> Column:
    kind = F.lower(F.trim(F.split(content_type, ";")[0]))
    return F.coalesce(kind.isin("", "text/html", "application/xhtml+xml"), F.lit(True))


def url_allowed(url: Column, safe: Column, allow_private: bool = False) -> Column:
    """Whether a URL may be fetched: scheme, then host name and addresses (safe: an array of flags), which allow_private passes over."""
    named = scheme_allowed(url)
    return named if allow_private else named & ~F.coalesce(host_blocked(host(url)), F.lit(False)) & F.coalesce(all_public(safe), F.lit(False))


def status_error(status: Column, content_type: Column) -> Column:
    """Error struct of a fetched page, or null."""
    e = lambda k, s: F.struct(F.format_string(STATUS_ERRORS[k], status.cast("string")) if "%s" in STATUS_ERRORS[k] else F.lit(STATUS_ERRORS[k]), F.lit(s))
    kinds = [(status.isin(401, 403), e("blocked", 502)), (status == 429, e("limited", 502)), ((status < 200) | (status > 299), e("failed", 502)), (~content_allowed(content_type), e("no_html", 415))]
    out = F.lit(None)
    for test, error in reversed(kinds):
        out = F.when(test, error.cast("struct<message:string,status:int>")).otherwise(out)
    return out
