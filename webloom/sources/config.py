"""Strict TOML configuration: unknown keys are errors, all have defaults."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any


@dataclass
class Crawl:
    user_agent: str = "webloom"
    max_depth: int = 32
    max_urls_per_host: int = 1000
    host_delay_ms: int = 1000
    recrawl_days: int = 30
    batch: int = 32


@dataclass
class Index:
    languages: list[str] = field(default_factory=list)  # none: all
    commit_docs: int = 1000
    commit_secs: int = 60


@dataclass
class Rank:
    weight: float = 0.3
    exact_up_to: int = 20_000
    least_nodes: int = 500


@dataclass
class Peers:
    allow: list[str] = field(default_factory=list)
    timeout_ms: int = 1500
    quota_bytes: int = 0


@dataclass
class Config:
    crawl: Crawl = field(default_factory=Crawl)
    index: Index = field(default_factory=Index)
    rank: Rank = field(default_factory=Rank)
    peers: Peers = field(default_factory=Peers)


def _fill(into: Any, values: dict, where: str) -> Any:
    known = {f.name: f for f in fields(into)}
    for key, value in values.items():
        if key not in known:
            raise ValueError(f"unknown key {where}{key}")
        now = getattr(into, key)
        if is_dataclass(now):
            if not isinstance(value, dict):
                raise ValueError(f"{where}{key} is a table")
            _fill(now, value, f"{where}{key}.")
        elif not isinstance(value, type(now)) and not (isinstance(now, float) and isinstance(value, int)):
            raise ValueError(f"{where}{key} is of another type")
        else:
            setattr(into, key, value)
    return into


def load(text: str) -> Config:
    out = _fill(Config(), tomllib.loads(text), "")
    if not 0 <= out.rank.weight <= 10:
        raise ValueError("rank.weight is from 0 to 10")
    if out.crawl.batch < 1 or out.index.commit_docs < 1 or out.crawl.host_delay_ms < 0:
        raise ValueError("counts are 1 at least, delays 0")
    return out


def is_peer_allowed(config: Config, peer: str) -> bool:
    return peer in config.peers.allow
