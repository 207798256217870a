"""Void values: null or, trimmed and in any letter case, one of a fixed list of spellings."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The spellings of "no value".
VOID_WORDS = ("", "null", "none", "n/a", "-", "–", "—")
_VOID = r"(?iU)^\s*(?:" + "|".join(VOID_WORDS) + r")\s*$"


def trimmed(c: Column) -> Column:
    """Trim every Unicode white-space character (``trim`` alone takes blanks only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_void(c: Column) -> Column:
    return F.coalesce(c.rlike(_VOID), F.lit(True))


def _leaves(c: Column, kind: T.StructType) -> Iterator[tuple[Column, T.DataType]]:
    for f in kind.fields:
        if isinstance(f.dataType, T.StructType):
            yield from _leaves(c[f.name], f.dataType)
        else:
            yield c[f.name], f.dataType


def has_value(c: Column, kind: T.DataType) -> Column:
    """True where the object holds at least one value, at any depth, that is not void."""
    if isinstance(kind, T.StructType):
        # One test over the texts of the object and its inner structs; containers and other leaves on their own.
        leaves = list(_leaves(c, kind))
        texts = [x for x, k in leaves if isinstance(k, T.StringType)]
        parts = [F.exists(F.array(*texts), lambda x: ~is_void(x))] if texts else []
        parts += [has_value(x, k) for x, k in leaves if not isinstance(k, T.StringType)]
        found = parts[0] if parts else F.lit(False)
        for p in parts[1:]:
            found = found | p
    elif isinstance(kind, T.ArrayType):
        found = F.exists(c, lambda x: has_value(x, kind.elementType))
    elif isinstance(kind, T.MapType):
        found = F.exists(F.map_values(c), lambda x: has_value(x, kind.valueType))
    elif isinstance(kind, T.StringType):
        found = ~is_void(c)
    else:
        found = c.isNotNull()
    return F.coalesce(found, F.lit(False))
