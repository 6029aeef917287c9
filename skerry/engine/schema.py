"""Column kinds, their widening order and schema evolution."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field, replace
from enum import IntEnum

from pyspark.sql import DataFrame
from pyspark.sql import types as T


class Kind(IntEnum):
    """Column kinds; their numbers are part of the dump format (fixed values)."""

    NULL = 0
    BOOL = 1
    INT = 2
    FLOAT = 3
    STRING = 4
    DATE = 5
    JSON = 6


NUMERIC = (Kind.BOOL, Kind.INT, Kind.FLOAT)
TYPES = {
    Kind.NULL: T.StringType(),  # until a first value comes
    Kind.BOOL: T.BooleanType(),
    Kind.INT: T.LongType(),
    Kind.FLOAT: T.DoubleType(),
    Kind.STRING: T.StringType(),
    Kind.DATE: T.TimestampNTZType(),
    Kind.JSON: T.StringType(),
}


class SchemaError(ValueError):
    """A write that the table's schema does not take."""


def kind_of_type(t: T.DataType) -> Kind:
    match t:
        case T.NullType():
            return Kind.NULL
        case T.BooleanType():
            return Kind.BOOL
        case T.ByteType() | T.ShortType() | T.IntegerType() | T.LongType():
            return Kind.INT
        case T.FloatType() | T.DoubleType() | T.DecimalType():
            return Kind.FLOAT
        case T.DateType() | T.TimestampType() | T.TimestampNTZType():
            return Kind.DATE
        case T.ArrayType() | T.MapType() | T.StructType() | T.VariantType():
            return Kind.JSON
    return Kind.STRING


def kind_of_value(v: object) -> Kind:
    match v:
        case None:
            return Kind.NULL
        case bool():
            return Kind.BOOL
        case int():
            return Kind.INT
        case float():
            return Kind.FLOAT
        case datetime.date():
            return Kind.DATE
        case dict() | list() | tuple():
            return Kind.JSON
    return Kind.STRING


def conflicts(existing: Kind, incoming: Kind) -> bool:
    """Whether a value of one kind cannot go into a column of another: NULL always can, numbers only
    upwards, and text, dates and JSON only into their own kind."""
    if Kind.NULL in (existing, incoming) or existing == incoming:
        return False
    if existing in NUMERIC and incoming in NUMERIC:
        return incoming < existing
    return True


def widened(existing: Kind, incoming: Kind) -> Kind:
    return max(existing, incoming) if Kind.NULL in (existing, incoming) or {existing, incoming} <= set(NUMERIC) else existing


@dataclass
class Table:
    """An immutable snapshot: writes replace it. ``df`` has the columns of ``kinds`` and, for written
    tables, the row number ``_rid`` in insertion order."""

    df: DataFrame | None
    kinds: dict[str, Kind] = field(default_factory=dict)
    enums: dict[str, list[str]] = field(default_factory=dict)
    locked: bool = False
    next_rid: int | None = None  # None: an attached table without row numbers
    parts: tuple[tuple[DataFrame, int], ...] = ()  # what ``df`` is the union of, with rows; none: one table

    def but(self, **changes) -> Table:
        return replace(self, **({"kinds": dict(self.kinds), "enums": {k: list(v) for k, v in self.enums.items()}} | changes))


def evolve(name: str, table: Table, incoming: dict[str, Kind], force_wipe: bool) -> tuple[dict[str, Kind], bool]:
    """The kinds after a write of ``incoming``, and whether the table's rows have to go first."""
    kinds, wipe = dict(table.kinds), False
    for column, kind in incoming.items():
        if column not in kinds:
            if table.locked:
                raise SchemaError(f"{name} is locked: {column} would be a new column")
            kinds[column] = kind
            continue
        old = kinds[column]
        if conflicts(old, kind):
            if table.locked or not force_wipe:
                raise SchemaError(f"{name}.{column} is {old.name}; {kind.name} does not go in")
            kinds[column], wipe = kind, True
        elif (new := widened(old, kind)) != old:
            if table.locked and old != Kind.NULL:
                raise SchemaError(f"{name} is locked: {column} would widen from {old.name} to {new.name}")
            kinds[column] = new
    return kinds, wipe
