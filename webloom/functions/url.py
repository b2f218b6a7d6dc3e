"""URL functions. The Column forms stay in the JVM; normalize() is the full form, over Arrow batches."""

from __future__ import annotations

import re
from functools import lru_cache
from urllib.parse import quote, urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LENGTH = 2048
TRACKING = r"(?:utm_[^=&#]*|gclid|fbclid|msclkid)"
_TRACKING = re.compile(TRACKING + r"\Z")
_PORTS = {"http": 80, "https": 443}


def host_of(url: Column) -> Column:
    """The host, lower case, without port or trailing dot; null if the URL has none."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"\.$", "")


def is_tracking(name: Column) -> Column:
    return F.regexp_like(name, F.lit(f"^{TRACKING}$"))


def strip_tracking(url: Column) -> Column:
    """Without fragment and tracking parameters, by regular expressions."""
    bare = F.regexp_replace(url, "#.*$", "")
    bare = F.regexp_replace(bare, rf"&{TRACKING}(=[^&]*)?(&{TRACKING}(=[^&]*)?)*(&|$)", "$4")
    bare = F.regexp_replace(bare, rf"\?{TRACKING}(=[^&]*)?(&{TRACKING}(=[^&]*)?)*(&|$)", "?")
    return F.regexp_replace(bare, r"[?&]$", "")


def robots_url(url: Column) -> Column:
    """Scheme and authority kept, the path replaced."""
    return F.regexp_replace(url, r"^(https?://[^/?#]+).*$", "$1/robots.txt")


def unsurt(host: Column) -> Column:
    """com,example,www to www.example.com."""
    return F.array_join(F.reverse(F.split(host, ",")), ".")


def seed_entry(line: Column) -> Column:
    """A bare host to its https root, a URL as it is, anything else to null."""
    line = F.trim(line)
    bare = F.regexp_like(line, F.lit(r"^[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+\.?$"))
    return F.when(bare, F.concat(F.lit("https://"), F.regexp_replace(F.lower(line), r"\.$", ""), F.lit("/"))).when(F.regexp_like(line, F.lit("^https?://[^/]")), line)


@lru_cache(50_000)
def normalize_url(url: str, base: str | None = None) -> str | None:
    """The canonical form, or None if there is none: http(s) only, no credentials, fragment, default port or tracking."""
    url = url.strip().translate({9: None, 10: None, 13: None})
    try:
        if base is not None:
            url = urljoin(base, url)
        parts = urlsplit(url)
        port = parts.port
        host = (parts.hostname or "").rstrip(".")
    except ValueError:
        return None
    scheme = parts.scheme.lower()
    if scheme not in _PORTS or not host or " " in host:
        return None
    if not host.isascii():
        try:
            import idna

            host = idna.encode(host, uts46=True).decode()
        except Exception as error:
            if isinstance(error, ImportError):
                raise
            return None
    path = _dots(quote(parts.path, safe="/%:@!$&'()*+,;=~-._")) or "/"
    query = "&".join(p for p in parts.query.split("&") if not _TRACKING.match(p.split("=", 1)[0])) if parts.query else ""
    query = quote(query, safe="%/?:@!$&()*+,;=~-._[]|^`{}")
    out = f"{scheme}://{host}" + (f":{port}" if port not in (None, _PORTS[scheme]) else "") + path + (f"?{query}" if query else "")
    return out if len(out) <= MAX_LENGTH else None


def _dots(path: str) -> str:
    out: list[str] = []
    segments = path.split("/")
    for i, s in enumerate(segments):
        last = i == len(segments) - 1
        low = s.lower().replace("%2e", ".")
        if low == "..":
            if len(out) > 1:
                out.pop()
            if last:
                out.append("")
        elif low == ".":
            if last:
                out.append("")
        else:
            out.append(s)
    return "/".join(out)


def normalize(url: Column, base: Column | None = None) -> Column:
    @F.arrow_udf("string")
    def alone(urls: pa.Array) -> pa.Array:
        return pa.array([None if u is None else normalize_url(u) for u in urls.to_pylist()], pa.string())

    @F.arrow_udf("string")
    def joined(urls: pa.Array, bases: pa.Array) -> pa.Array:
        return pa.array([None if u is None or b is None else normalize_url(u, b) for u, b in zip(urls.to_pylist(), bases.to_pylist())], pa.string())

    return alone(url) if base is None else joined(url, base)
