"""robots.txt: which rules hold, and whether they allow a path (RFC 9309)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_BYTES = 512 * 1024


@dataclass
class Rules:
    rules: list[tuple[bool, str]] = field(default_factory=list)  # (allow, pattern)
    delay: float | None = None
    sitemaps: list[str] = field(default_factory=list)


@lru_cache(10_000)
def parse_robots(body: str, agent: str) -> Rules:
    """The rules of the groups that name the product token, else of those for *."""
    groups: list[tuple[set[str], Rules]] = []
    sitemaps: list[str] = []
    fresh = False
    for line in body[:MAX_BYTES].splitlines():
        key, colon, value = line.split("#", 1)[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon:
            continue
        if key == "user-agent":
            if not fresh:
                groups.append((set(), Rules()))
            groups[-1][0].add(re.split(r"[/\s]", value.lower(), maxsplit=1)[0])
            fresh = True
        elif key == "sitemap":
            sitemaps.append(value)
        elif groups:
            fresh = False
            if key in ("allow", "disallow") and value:
                groups[-1][1].rules.append((key == "allow", value))
            elif key == "crawl-delay":
                try:
                    groups[-1][1].delay = float(value)
                except ValueError:
                    pass
    out = Rules(sitemaps=sitemaps)
    for wanted in (agent.lower(), "*"):
        mine = [r for names, r in groups if wanted in names]
        if mine:
            for r in mine:
                out.rules += r.rules
                out.delay = r.delay if out.delay is None else out.delay
            break
    return out


@lru_cache(50_000)
def _pattern(rule: str) -> re.Pattern:
    end = rule.endswith("$")
    return re.compile(".*".join(map(re.escape, rule.rstrip("$").split("*"))) + (r"\Z" if end else ""), re.S)


def is_allowed(body: str, agent: str, path: str) -> bool:
    """The longest matching rule decides, allow before disallow; no match allows."""
    if path == "/robots.txt":
        return True
    best = max(((len(p), allow) for allow, p in parse_robots(body, agent).rules if _pattern(p).match(path)), default=(0, True))
    return best[1]


def allowed(body: Column, path: Column, agent: str) -> Column:
    """By status before this: no body (4xx) allows all."""

    @F.arrow_udf("boolean")
    def run(bodies: pa.Array, paths: pa.Array) -> pa.Array:
        return pa.array([p is not None and (b is None or is_allowed(b, agent, p)) for b, p in zip(bodies.to_pylist(), paths.to_pylist())], pa.bool_())

    return run(body, path)


def outcome(status: Column) -> Column:
    """cached for 2xx, allow_all for 4xx, unavailable for 5xx and no answer."""
    return F.when(status.between(200, 299), "cached").when(status.between(400, 499), "allow_all").otherwise("unavailable")
