"""Named parameters: binding checks and the merge of a handler's parameters."""

from __future__ import annotations

import re
from collections.abc import Mapping
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"""'(?:[^']|'')*'|"(?:[^"]|"")*"|`(?:[^`]|``)*`|\[[^\]]*\]|--[^\n]*|/\*.*?(?:\*/|\Z)|::|:(?P<name>[A-Za-z_]\w*)|(?P<mark>\?)|(?P<open>['"`\[])""",
    re.S,
)


class BindingError(ValueError):
    pass


def names_in(sql: str) -> list[str]:
    """Named parameters in order of use; literals, quoted names and comments hold none. A ``?`` or an unended literal is an error, an unended block comment is not."""
    out = []
    for m in _TOKEN.finditer(sql):
        if m["mark"]:
            raise BindingError("positional ? can't stand beside named parameters")
        if m["open"]:
            raise BindingError(f"unended {m['open']}")
        if m["name"]:
            out.append(m["name"])
    return out


def positional(sql: str, params: Mapping[str, object]) -> tuple[str, list[object]]:
    """SQL with ``?`` and the values in order; a value used twice comes twice, an unknown name is an error."""
    values: list[object] = []
    for name in names_in(sql):
        if name not in params:
            raise BindingError(f"no value for :{name}")
        values.append(params[name])
    return _TOKEN.sub(lambda m: "?" if m["name"] else m[0], sql), values


def merged(path: Mapping[str, str], url: str, body: object) -> dict[str, object]:
    """Handler parameters: path over query over body; a repeated query key has its first value, body fields that aren't scalars go."""
    out = {k: v for k, v in (body.items() if isinstance(body, Mapping) else ()) if v is None or isinstance(v, str | int | float | bool)}
    query: dict[str, str] = {}
    for k, v in parse_qsl(urlsplit(url).query, keep_blank_values=True):
        query.setdefault(k, v)
    return {**out, **query, **path}


def merged_columns(body: Column, query: Column, path: Column) -> Column:
    """The same for maps of strings: keys of ``path`` win over ``query``, these over ``body``."""
    only = lambda m, *over: F.map_filter(m, lambda k, _: ~F.array_contains(F.flatten(F.array(*map(F.map_keys, over))), k))
    return F.map_concat(only(body, query, path), only(query, path), path)
