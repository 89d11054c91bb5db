"""Names: snake and camel case, identifier checks, the ASCII-only sort key."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# fixed values: the patterns of the case rules and of names, which have to give the same columns as the declarations' users know
_IDENT = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_HUMP, _UNDER, _UNDER_KEY = r"([a-z0-9])([A-Z])", r"_([a-z0-9])", r"_([a-z])"


def to_snake(name: str) -> str:
    return re.sub(_HUMP, r"\1_\2", name).lower()


def to_camel(name: str) -> str:
    """Column names: an underscore before a letter or digit goes, what follows is upper-cased."""
    return re.sub(_UNDER, lambda m: m[1].upper(), name)


def to_camel_key(name: str) -> str:
    """Payload keys: only letters are joined, so ``line_1`` keeps its underscore."""
    return re.sub(_UNDER_KEY, lambda m: m[1].upper(), name)


def snake_column(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, _HUMP, "$1_$2"))


def nocase(c: Column) -> Column:
    """Sort key that folds A-Z only."""
    return F.translate(c, UPPER, LOWER)


def checked(name: str) -> str:
    """The identifier itself, or an error: table and column names go into SQL text."""
    if not _IDENT.fullmatch(name):
        raise ValueError(f"not a plain identifier: {name!r}")
    return name
