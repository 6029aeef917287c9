"""Host bindings: dataclass mapping and a small DB-API facade over registered databases."""

from __future__ import annotations

import contextlib
import dataclasses
import typing
from collections.abc import Iterable, Iterator

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame

from ..plans.normalize import SqlError
from . import dml
from .database import Database, Transaction
from .schema import SchemaError

apilevel, threadsafety, paramstyle = "2.0", 1, "qmark"
_REGISTRY: dict[str, Database] = {}


class Error(Exception):
    """What the facade raises; the engine's error is its cause."""


class DatabaseError(Error):
    pass


class ProgrammingError(DatabaseError):
    """The statement cannot be read or names what is not there."""


class IntegrityError(DatabaseError):
    """The schema does not take the write."""


class InterfaceError(Error):
    pass


@contextlib.contextmanager
def translated_errors() -> Iterator[None]:
    try:
        yield
    except SchemaError as e:
        raise IntegrityError(str(e)) from e
    except (SqlError, AnalysisException, ParseException) as e:
        raise ProgrammingError(str(e)) from e


def flat(value: object) -> dict[str, object]:
    """Columns of a dataclass: fields by name or metadata "db", nested dataclasses inlined, "-" left out; a
    converter in metadata "to_db" makes a field's cell."""
    out: dict[str, object] = {}
    for f in dataclasses.fields(value):
        v, name = getattr(value, f.name), f.metadata.get("db", f.name)
        if name == "-":
            continue
        if "to_db" in f.metadata:
            out[name] = f.metadata["to_db"](v)
        elif dataclasses.is_dataclass(v):
            out |= flat(v)
        else:
            out[name] = v
    return out


def insert_dataclass(db: Database, table: str, value: object) -> None:
    dml.insert_rows(db, table.lower(), [flat(value)], db.force_wipe)


def nested_type(hint: object) -> type | None:
    """The dataclass of a field's type, also of one that may be None."""
    if dataclasses.is_dataclass(hint):
        return hint
    return next((t for t in typing.get_args(hint) if dataclasses.is_dataclass(t)), None)


def columns_of(cls: type) -> list[str]:
    """The columns of a dataclass in lower case, those of nested ones too."""
    out, hints = [], typing.get_type_hints(cls)
    for f in dataclasses.fields(cls):
        inner = nested_type(hints[f.name])
        out += columns_of(inner) if inner is not None and "from_db" not in f.metadata else [f.metadata.get("db", f.name).lower()]
    return out


def built(cls: type, cells: dict[str, object]) -> object:
    """An object of ``cls`` from the cells of a row by column name in lower case. Nested dataclasses take theirs
    from the same row (None where all their cells are and the field may be None), "from_db" converts a cell."""
    hints, given = typing.get_type_hints(cls), {}
    for f in dataclasses.fields(cls):
        name = f.metadata.get("db", f.name).lower()
        inner = nested_type(hints[f.name])
        if inner is not None and "from_db" not in f.metadata:
            value = built(inner, cells)
            empty = all(cells.get(c) is None for c in columns_of(inner))
            given[f.name] = None if empty and hints[f.name] is not inner else value
        elif name != "-" and name in cells:
            given[f.name] = f.metadata["from_db"](cells[name]) if "from_db" in f.metadata else cells[name]
        elif f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING:
            given[f.name] = None
    return cls(**given)


def scan_rows(df: DataFrame, cls: type) -> Iterator[object]:
    """Rows as dataclass objects, streamed partition by partition; columns without a field are ignored."""
    columns = [c.lower() for c in df.columns]
    for row in df.toLocalIterator():
        yield built(cls, dict(zip(columns, row, strict=True)))


def register(db: Database, name: str = "default") -> None:
    if _REGISTRY.setdefault(name, db) is not db:
        raise ValueError(f"{name} is registered")


def unregister(name: str = "default") -> None:
    _REGISTRY.pop(name, None)


def connect(name: str = "default") -> Connection:
    if name not in _REGISTRY:
        raise InterfaceError(f"no database {name} is registered")
    return Connection(_REGISTRY[name])


class Connection:
    def __init__(self, db: Database):
        self.db, self.tx = db, None

    def begin(self) -> None:
        if self.tx:
            raise RuntimeError("a transaction is open")
        self.tx: Transaction | None = self.db.begin()

    def cursor(self) -> Cursor:
        return Cursor(self.db)

    def commit(self) -> None:
        if self.tx:
            self.tx.commit()
            self.tx = None

    def rollback(self) -> None:
        if self.tx:
            self.tx.rollback()
            self.tx = None

    def close(self) -> None:
        self.rollback()


class Cursor:
    arraysize, rowcount = 1, -1

    def __init__(self, db: Database):
        self.db, self.description, self._rows = db, None, iter(())

    def execute(self, sql: str, params: object = None) -> Cursor:
        """rowcount is -1: what a lazy result or a write has touched is not counted."""
        with translated_errors():
            writes = dml.first_word(sql) in ("insert", "update", "delete")
            if writes and dml.returning_of(dml.tokenize(sql))[1] is None:
                self.db.exec(sql, params)
                self.description, self._rows = None, iter(())
            else:
                df = self.db.query(sql, params)
                self.description = [(f.name, f.dataType.simpleString(), None, None, None, None, f.nullable) for f in df.schema]
                self._rows = df.toLocalIterator()
        return self

    def executemany(self, sql: str, seq: Iterable[object]) -> Cursor:
        """One after the other; results are not kept."""
        for params in seq:
            self.execute(sql, params)
        self.description, self._rows = None, iter(())
        return self

    def fetchone(self) -> tuple | None:
        row = next(self._rows, None)
        return tuple(row) if row is not None else None

    def fetchmany(self, size: int | None = None) -> list[tuple]:
        return [r for _ in range(size or self.arraysize) if (r := self.fetchone()) is not None]

    def fetchall(self) -> list[tuple]:
        return [tuple(r) for r in self._rows]

    def close(self) -> None:
        self._rows = iter(())
