"""HTTP sink for replayed requests, and lenient bodies."""

from __future__ import annotations

import json
import urllib.error
import urllib.request

from pyspark.sql import Column
from pyspark.sql import functions as F

TIMEOUT_S = 10


class NetworkError(RuntimeError):
    """No answer came."""


def parse_body(text: str | None, is_json: bool) -> object:
    """Nothing for no body, text unless it is said to be JSON, raw text if the JSON is broken."""
    if not text:
        return None
    if is_json:
        try:
            return json.loads(text)
        except ValueError:
            return text
    return text


def parsed_body(text: Column, is_json: Column) -> Column:
    """:func:`parse_body` of a column: (value, text), the value as a variant where JSON parses, the text unless the body is empty."""
    return F.struct(F.when(is_json, F.try_parse_json(text)).alias("value"), F.when(text != "", text).alias("text"))


def send(base: str, method: str, path: str, body: object = None, headers: dict[str, str] | None = None, timeout: float = TIMEOUT_S) -> tuple[int, object]:
    """(status, body). A JSON header goes with bodies that aren't text."""
    head = dict(headers or {})
    data = None
    if body is not None:
        if not isinstance(body, str):
            head.setdefault("Content-Type", "application/json")
            body = json.dumps(body)
        data = body.encode()
    req = urllib.request.Request(f"{base.rstrip('/')}/{path.lstrip('/')}" if base else path, data=data, method=method, headers=head)
    try:
        with urllib.request.urlopen(req, timeout=timeout) as r:
            return r.status, parse_body(r.read().decode(), "json" in r.headers.get("Content-Type", ""))
    except urllib.error.HTTPError as e:
        return e.code, parse_body(e.read().decode(errors="replace"), "json" in e.headers.get("Content-Type", ""))
    except OSError as e:
        raise NetworkError(str(e)) from e


def strip_param(url: str, name: str = "_rsc") -> str:
    """A URL without one query parameter."""
    head, _, query = url.partition("?")
    kept = [p for p in query.split("&") if p and p.split("=")[0] != name]
    return head + ("?" + "&".join(kept) if kept else "")


def without_param(url: Column, name: str = "_rsc") -> Column:
    """:func:`strip_param` of a column."""
    parts = F.split(url, r"\?", 2)
    kept = F.filter(F.split(F.try_element_at(parts, F.lit(2)), "&"), lambda p: (p != "") & (F.substring_index(p, "=", 1) != name))
    return F.concat(parts[0], F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
