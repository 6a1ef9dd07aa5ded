"""What a request asks for: lists, numbers and limits out of strings, and strict checks of a body. Plain Python, as these are a handful of values."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from tidemark.operators.graph import Filters

#: Fixed value: names of fields that a request must not carry.
SECRET_FIELDS = re.compile(r"(?i)cookie|token|passw|secret|session|api[_-]?key|authorization|credential")


def distinct(items: list | None) -> list:
    """Without empty ones, each once, in order."""
    return list(dict.fromkeys(x for x in items or [] if x))


def parse_list(value: str | None, allowed: list[str] | None = None) -> list[str] | None:
    """Comma-separated; only the allowed ones if there is such a list."""
    if not value:
        return None
    items = [x.strip() for x in value.split(",")]
    return [x for x in items if x and (allowed is None or x in allowed)]


def parse_number(value: str | None) -> float | None:
    if not value:
        return None
    try:
        n = float(value)
    except ValueError:
        return None
    return n if math.isfinite(n) else None


def resolve_batch(asked: str | None, batches: list[str], default: str = "S2026") -> str | None:
    """The asked one if it is known, else the default, else the first."""
    return next((b for b in (asked, default) if b in batches), batches[0] if batches else None)


def filters_of(query: dict[str, str], platforms: list[str]) -> Filters:
    some = lambda key, allowed=None: tuple(distinct(parse_list(query.get(key), allowed)))
    return Filters(parse_number(query.get("minScore")), some("industries"), some("partners"), some("models"), some("platforms", platforms), query.get("q") or None)


def secret_fields(body, path: str = "") -> list[str]:
    """Paths of fields whose names speak of secrets, anywhere in a body."""
    if isinstance(body, dict):
        own = [f"{path}.{k}".strip(".") for k in body if SECRET_FIELDS.search(str(k))]
        return own + [p for k, v in body.items() for p in secret_fields(v, f"{path}.{k}".strip("."))]
    if isinstance(body, list):
        return [p for i, v in enumerate(body) for p in secret_fields(v, f"{path}[{i}]")]
    return []


@dataclass(frozen=True)
class BatchRequest:
    """An ingestion request; `of` raises ValueError on unknown fields, wrong types, values out of bounds and secrets."""

    batch: str = "YC Spring 2026"
    flags: dict[str, bool] = field(default_factory=dict)
    max_companies: int | None = None
    platforms: tuple[str, ...] = ()

    @classmethod
    def of(cls, body: dict, platforms: list[str]) -> BatchRequest:
        if found := secret_fields(body):
            raise ValueError(f"rejected fields: {', '.join(found)}")
        if extra := set(body) - {"batchSlug", "options"}:
            raise ValueError(f"unknown fields: {sorted(extra)}")
        batch, options = body.get("batchSlug", cls.batch), body.get("options", {})
        if not isinstance(batch, str) or not 1 <= len(batch.strip()) <= 64:
            raise ValueError("batchSlug: 1 to 64 characters")
        names = {"demo", "refreshProfiles", "refreshPosts"}
        if not isinstance(options, dict) or (extra := set(options) - names - {"maxCompanies", "platforms"}):
            raise ValueError(f"options: unknown fields {sorted(extra) if isinstance(options, dict) else ''}")
        most, wanted = options.get("maxCompanies"), options.get("platforms", [])
        if most is not None and (type(most) is not int or not 1 <= most <= 200):
            raise ValueError("maxCompanies: a whole number from 1 to 200")
        if not isinstance(wanted, list) or len(wanted) > 12 or any(p not in platforms for p in wanted):
            raise ValueError("platforms: at most 12 known ones")
        if any(not isinstance(options[k], bool) for k in names & set(options)):
            raise ValueError("flags are true or false")
        return cls(batch.strip(), {k: options[k] for k in names & set(options)}, most, tuple(wanted))
