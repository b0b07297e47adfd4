"""Sort keys: names, sort expressions and values that compare like rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quote(name: str) -> str:
    """A column's name as Spark takes it literally."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    return F.col(quote(name))


class MissingColumns(ValueError):
    """A sort column that the table has not."""


# Fixed value: how a missing column is told.
MISSING = "missing sort columns: {missing}. Valid fields: {fields}"


def check_columns(keys: Sequence[str], schema: T.StructType) -> None:
    """Raise unless each key is a column, by its exact name, of a type that has an order."""
    missing = [k for k in keys if k not in schema.fieldNames()]
    if missing:
        raise MissingColumns(MISSING.format(missing=missing, fields=sorted(schema.fieldNames())))
    bad = [k for k in keys if not orderable(schema[k].dataType)]
    if bad:
        raise ValueError(f"sort columns of a type without order: {bad}")


def orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return orderable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(orderable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType, T.CalendarIntervalType))


def sort_by(keys: Sequence[str], nulls_first: bool = True) -> list[Column]:
    """Ascending sort expressions; NULLs first or last in each column."""
    return [column(k).asc_nulls_first() if nulls_first else column(k).asc_nulls_last() for k in keys]


def key_value(keys: Sequence[str], nulls_first: bool = True) -> Column:
    """A struct that compares as sort_by() sorts. A struct's NULL fields are its least and equal each other; a flag
    before each column puts them last instead."""
    fields: list[Column] = []
    for i, k in enumerate(keys):
        if not nulls_first:
            fields.append(column(k).isNull().alias(f"n{i}"))
        fields.append(column(k).alias(f"c{i}"))
    return F.struct(*fields)
