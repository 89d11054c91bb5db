"""Entity declarations (YAML), operation maps and their validation."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

import yaml

METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH")
KNOWN = (*METHODS, "HEAD")


class DeclarationError(ValueError):
    """All faults of a declaration, one a line."""


@dataclass(frozen=True)
class Aggregate:
    field: str
    table: str
    on: str


@dataclass(frozen=True)
class Route:
    """One declared request of a table."""

    table: str
    method: str
    path: str
    joins: tuple[str, ...] = ()
    aggregates: tuple[Aggregate, ...] = ()
    select: str | None = None
    params: Mapping[str, str] = field(default_factory=dict)
    defaults: Mapping[str, object] = field(default_factory=dict)


@dataclass(frozen=True)
class Declaration:
    prefixes: dict[str, str]  # prefix -> table, in order of declaration
    routes: tuple[Route, ...]

    def paths(self) -> list[str]:
        """Prefixes, then distinct paths, in order of declaration."""
        return list(dict.fromkeys([*self.prefixes, *(r.path for r in self.routes)]))

    def tables(self) -> list[str]:
        return sorted({*self.prefixes.values(), *(r.table for r in self.routes)})


def segments(path: str) -> list[str]:
    """Parts between slashes; empty ones don't count."""
    return [s for s in path.split("/") if s]


def hole(segment: str) -> str | None:
    """The parameter's name if the segment is a hole; ``{}`` is plain text."""
    return segment[1:-1] if len(segment) > 2 and segment[0] == "{" and segment[-1] == "}" else None


def _aggregate(a: Mapping) -> Aggregate:
    on = a.get("on", a.get(True))  # YAML reads a bare ``on`` as true
    return Aggregate(a["field"], a["table"], on)


def load(text: str) -> Declaration:
    """A declaration from YAML. Tables without a rule are skipped; everything wrong is reported at once."""
    faults: list[str] = []
    prefixes: dict[str, str] = {}
    routes: list[Route] = []
    seen: dict[str, str] = {}
    for table, rule in ((yaml.safe_load(text) or {}).get("entities") or {}).items():
        if rule is None:
            continue
        if isinstance(rule, str):
            if not rule.startswith("/") or rule.strip("/") == "":
                faults.append(f"{table}: a prefix starts with / and is more than / ({rule!r})")
            elif rule in prefixes:
                faults.append(f"{table}: prefix {rule} is declared by {prefixes[rule]} too")
            else:
                prefixes[rule] = table
            continue
        for one in rule:
            one = {"path": one} if isinstance(one, str) else one
            path = one.get("path", "")
            if not path.startswith("/"):
                faults.append(f"{table}: path {path!r} does not start with /")
                continue
            methods = METHODS if not one.get("method") else (str(one["method"]).upper(),)
            for method in methods:
                if method not in KNOWN:
                    faults.append(f"{table}: unknown method {method}")
                    continue
                key = f"{method} {path}"
                if key in seen:
                    faults.append(f"{table}: {key} is declared by {seen[key]} too")
                    continue
                seen[key] = table
                routes.append(
                    Route(table, method, path, tuple(one.get("joins") or ()), tuple(_aggregate(a) for a in one.get("aggregates") or ()), one.get("select"), dict(one.get("params") or {}), dict(one.get("defaults") or {}))
                )
    for prefix, table in prefixes.items():
        faults += [f"{table}: prefix {prefix} covers {r.path} of {r.table}" for r in routes if r.table != table and (r.path == prefix or r.path.startswith(f"{prefix}/"))]
    if faults:
        raise DeclarationError("\n".join(faults))
    return Declaration(prefixes, tuple(routes))


@dataclass(frozen=True)
class Operation:
    operation_id: str
    method: str
    path: str
    connectivity: str
    handle: Callable | str
    dedup_window_ms: int | None = None


def normalised(path: str) -> str:
    """Holes by position only: two names for one place are one path."""
    return re.sub(r"\{[^/]+\}", "{}", path)


def check_operations(operations: list[Mapping]) -> list[Operation]:
    """Operations with all required fields, a known connectivity and no request declared twice."""
    faults, out, seen = [], [], {}
    for i, o in enumerate(operations):
        missing = [f for f in ("operation_id", "method", "path", "connectivity") if not o.get(f)]
        if missing:
            faults.append(f"operation {i}: missing {', '.join(missing)}")
            continue
        if o["connectivity"] not in ("offline", "online"):
            faults.append(f"{o['operation_id']}: connectivity is offline or online")
        key = f"{o['method'].upper()} {normalised(o['path'])}"
        if key in seen:
            faults.append(f"{o['operation_id']}: {key} is {seen[key]} already")
        seen[key] = o["operation_id"]
        out.append(Operation(o["operation_id"], o["method"].upper(), o["path"], o["connectivity"], o.get("handle", ""), o.get("dedup_window_ms")))
    if faults:
        raise DeclarationError("\n".join(faults))
    return out


@dataclass(frozen=True)
class Config:
    admin_url: str | None
    buckets: tuple[str, ...]
    schema_file: str | None
    token_endpoint: str | None


def load_config(text: str) -> Config:
    """Connection settings; known keys outside their block mean lost indentation and are refused."""
    data = yaml.safe_load(text) or {}
    block = data.get("sync")
    stray = [k for k in ("adminUrl", "buckets", "schemaFile", "tokenEndpoint") if k in data]
    if stray and "sync" in data:
        raise DeclarationError(f"{', '.join(stray)} must be indented under sync")
    block = block if isinstance(block, Mapping) else data
    return Config(block.get("adminUrl"), tuple(block.get("buckets") or ()), block.get("schemaFile"), block.get("tokenEndpoint"))
