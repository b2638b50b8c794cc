"""Run settings, read once and passed down explicitly."""

from __future__ import annotations

import ast
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class EngineConfig:
    """Paths and rules of one run.

    Paths may point at any Hadoop-compatible file system. Nothing here holds a
    clock: every job takes its reference time as an ``as_of`` argument.
    """

    raw_offers: str = ""
    offers: str = ""
    seekers: str = ""
    skills: str = ""
    keywords: str = ""
    pages: str = ""
    crawled: str = ""
    word_list: str = ""
    embeddings: str = ""
    matches: str = ""
    reports: str = ""
    quarantine: str = ""
    base_url: str = ""
    excluded_companies: tuple[str, ...] = ()
    unavailable_tags: tuple[str, ...] = ()
    report_users: tuple[str, ...] = ()
    recency_days: int = 7
    english_threshold: float = 0.6
    embed_limit: int | None = None
    key_on: str = "raw"

    @classmethod
    def from_mapping(cls, values: Mapping[str, str]) -> EngineConfig:
        """Build a config from text values; lists come as Python literals."""
        known = {f.name: f for f in fields(cls)}
        unknown = sorted(set(values) - set(known))
        if unknown:
            raise ValueError(f"unknown settings: {unknown}")
        parsed = {}
        for name, text in values.items():
            default = known[name].default
            if isinstance(default, tuple):
                value = ast.literal_eval(text) if isinstance(text, str) else text
                parsed[name] = tuple(value)
            elif name == "embed_limit":
                parsed[name] = int(text) if text not in ("", None) else None
            else:
                parsed[name] = type(default)(text)
        return cls(**parsed)
