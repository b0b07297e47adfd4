"""Predicates that pick a partition, as Columns and as SQL text, from a log's partition values."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderkeep.functions.keys import column

_INT = re.compile(r"[+-]?\d+")
_DECIMAL = re.compile(r"[0-9.+-]*")
#: Kinds of literal by a type's name in a log's schema.
KINDS = {"byte": "int", "short": "int", "integer": "int", "long": "int", "float": "float", "double": "float", "boolean": "bool"}


def literal(raw: str, type_name: str | None) -> str:
    """The SQL literal of a partition value, bare where its type and text allow it, else quoted."""
    value = raw.strip('"')
    kind = "decimal" if (type_name or "").startswith("decimal") else KINDS.get(type_name or "")
    if kind == "int" and _INT.fullmatch(value):
        return value
    if kind == "float" and _is_float(value):
        return value
    if kind == "bool" and value.lower() in ("true", "false"):
        return value.upper()
    if kind == "decimal" and _DECIMAL.fullmatch(value):
        return value
    return "'" + value.replace("'", "''") + "'"


def _is_float(text: str) -> bool:
    try:
        float(text)
    except ValueError:
        return False
    return "_" not in text and text == text.strip()


def sql_predicate(values: Sequence[tuple[str, str | None]], types: Mapping[str, str] | None = None, null_text: bool = False) -> str:
    """SQL that holds for the rows of a partition. None is NULL; null_text also takes the text null, in any case, for NULL.

    No columns give TRUE; without types every value is quoted."""
    parts = []
    for name, raw in values:
        if raw is None or (null_text and raw.strip('"').lower() == "null"):
            parts.append(f'"{name}" IS NULL')
        else:
            parts.append(f'"{name}" = {literal(raw, (types or {}).get(name))}')
    return " AND ".join(parts) or "TRUE"


def column_predicate(values: Sequence[tuple[str, str | None]], schema: T.StructType) -> Column:
    """The same as a Column, with typed literals, so that Spark can prune partitions and push it down. A text that is no
    value of its column's type picks no row."""
    parts = []
    for name, raw in values:
        kind = schema[name].dataType
        parts.append(column(name).isNull() if raw is None else (column(name) == F.lit(raw).try_cast(kind)))
    return reduce(lambda a, b: a & b, parts, F.lit(True))
