"""Database: named immutable DataFrames with SQL, DML, transactions and persistence."""

from __future__ import annotations

import datetime
import json
import os
import threading
import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import register_functions
from ..plans.normalize import SqlError, to_spark
from ..storage import stored
from . import dml
from .lint import COLUMN_TYPES, TARGETS, PortabilityWarning, QueryLog, ddl, lint
from .params import bind
from .schema import Kind, SchemaError, Table, evolve, kind_of_type


class Database:
    """A flat namespace of tables over a session of its own.

    Queries are Spark SQL after translation and run where Catalyst puts them. Writes make new
    snapshots: a table is rewritten to the shared folder and its view replaced, under one lock, so
    readers keep the snapshot they started from.
    """

    def __init__(self, spark: SparkSession, force_wipe: bool = False, target: str | None = None, on_warning: Callable[[PortabilityWarning], None] | None = None):
        if target is not None and target not in TARGETS:
            raise ValueError(f"unknown target {target!r}; known: {', '.join(TARGETS)}")
        self.spark = spark.newSession()
        register_functions(self.spark)
        self.force_wipe, self.target, self.on_warning = force_wipe, target, on_warning
        self.tables: dict[str, Table] = {}
        self.locked = False
        self.warnings: list[PortabilityWarning] = []
        self.log = QueryLog()
        self._lock = threading.RLock()

    # Tables

    def publish(self, name: str, table: Table) -> None:
        """Makes ``table`` the snapshot that later statements see."""
        self.tables[name] = table
        if table.df is not None:
            table.df.select(*table.kinds).createOrReplaceTempView(name)
        else:
            self.spark.catalog.dropTempView(name)  # no rows yet, or none any more

    def attach(self, path: str, name: str | None = None) -> None:
        """A Parquet table, read in place; it is copied only if a statement writes to it."""
        name = (name or os.path.basename(path).removesuffix(".parquet")).lower()
        df = self.spark.read.parquet(path)
        self.publish(name, Table(df, {f.name: kind_of_type(f.dataType) for f in df.schema}))

    def create(self, name: str, rows: Iterable[dict]) -> None:
        """Rows of dictionaries as a table, with inferred kinds."""
        dml.insert_rows(self, name.lower(), list(rows), self.force_wipe)

    def table(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def kinds(self, name: str) -> dict[str, Kind]:
        return dict(self.tables[name].kinds)

    # Schema services

    def lock_schema(self) -> None:
        self._set_locks(self.tables, True)
        self.locked = True

    def unlock_schema(self) -> None:
        self._set_locks(self.tables, False)
        self.locked = False

    def lock_table(self, name: str) -> None:
        self._set_locks([name], True)

    def unlock_table(self, name: str) -> None:
        self._set_locks([name], False)

    def _set_locks(self, names: Iterable[str], to: bool) -> None:
        with self._lock:
            for name in list(names):
                self.tables[name] = self.tables.get(name, Table(None)).but(locked=to)

    def declare_enum(self, name: str, column: str, values: Iterable[str]) -> None:
        """Restricts a text column; declared again, the set may only grow, and rows must fit."""
        values = list(dict.fromkeys(values))
        with self._lock:
            table = self.tables.get(name, Table(None))
            if lost := set(table.enums.get(column, [])) - set(values):
                raise SchemaError(f"{name}.{column}: {sorted(lost)} cannot be taken out of the enumeration")
            if table.df is not None and column in table.kinds and table.df.where(F.col(column).isNotNull() & ~F.col(column).isin(values)).limit(1).count():
                raise SchemaError(f"{name}.{column} holds values outside {values}")
            self.tables[name] = table.but(enums={**table.enums, column: values})

    def upsert_schema(self, name: str, columns: dict[str, Kind], force_wipe: bool | None = None) -> None:
        """Adds or widens columns without rows."""
        with self._lock:
            table = self.tables.get(name, Table(None))
            kinds, wipe = evolve(name, table, columns, self.force_wipe if force_wipe is None else force_wipe)
            self.publish(name, dml.reshaped(self, table, kinds, wipe))

    # Statements

    def query(self, sql: str, params: object = None, force_wipe: bool | None = None) -> DataFrame:
        """A SELECT, UNION or WITH query, or a write with RETURNING. Lazy, unless a query log is kept."""
        return self._run("query", sql, params, force_wipe)

    def exec(self, sql: str, params: object = None, force_wipe: bool | None = None) -> None:
        """A write: INSERT, UPDATE, DELETE, also behind WITH. Its whole effect shows, or none."""
        self._run("exec", sql, params, force_wipe)

    def _run(self, op: str, sql: str, params: object, force_wipe: bool | None) -> DataFrame | None:
        began, error, rows = time.time(), None, None
        try:
            self._warn(sql)
            text, args = bind(sql, params)
            first = dml.first_word(text)
            if first in ("insert", "update", "delete"):
                with self._lock:
                    returned = dml.run(self, text, args, self.force_wipe if force_wipe is None else force_wipe)
                if op == "query" and returned is None:
                    raise SqlError("a write in query() needs RETURNING")
            elif op == "exec":
                raise SqlError(f"exec() takes writes; {first.upper() or 'this'} is none")
            else:
                returned = self.spark.sql(to_spark(text), args=args)
            if op == "query" and self.log.path:  # a logged query runs here, once: the log has its time and its rows
                returned = stored(returned, "logged")
                rows = returned.count()
            return returned
        except Exception as e:
            error = e
            raise
        finally:
            self.log.record(op, sql, began, error, rows)

    def _warn(self, sql: str) -> None:
        if self.target:
            for w in lint(sql, self.target):
                self.warnings.append(w)
                if self.on_warning:
                    self.on_warning(w)

    def clear_warnings(self) -> None:
        self.warnings.clear()

    def generate_ddl(self, dialect: str = "") -> str:
        dialect = dialect.strip().lower() or (self.target if self.target in COLUMN_TYPES else "")
        return ddl(self.tables, dialect)

    # Transactions

    def begin(self) -> Transaction:
        return Transaction(self)

    # Persistence

    def save(self, folder: str) -> None:
        """Every table as Parquet and a manifest, through Spark, so any store it can write will do. Tables go to
        folders of a name of their own and the manifest that points to them is written last: until then the
        snapshot before it stays whole."""
        with self._lock:
            manifest = []
            for name, t in self.tables.items():
                place = f"{name}-{uuid.uuid4().hex[:12]}"
                if t.df is not None:
                    t.df.write.parquet(f"{folder}/{place}")
                kinds = {c: int(k) for c, k in t.kinds.items()}
                manifest.append(json.dumps({"name": name, "place": place, "kinds": kinds, "enums": t.enums, "locked": t.locked, "next_rid": t.next_rid, "rows": t.df is not None}))
            self.spark.createDataFrame([(m,) for m in manifest], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")
        self._log_beside(folder)

    def load(self, folder: str) -> None:
        """Replaces all tables by saved ones. Rows are copied, so a later save to the same folder is safe."""
        with self._lock:
            tables = {}
            for row in self.spark.read.text(f"{folder}/manifest").collect():  # a row for each table
                m = json.loads(row.value)
                df = stored(self.spark.read.parquet(f"{folder}/{m['place']}"), m["name"]) if m["rows"] else None
                tables[m["name"]] = Table(df, {c: Kind(k) for c, k in m["kinds"].items()}, m["enums"], m["locked"], m["next_rid"])
            self._replace(tables)
        self._log_beside(folder)

    def _log_beside(self, folder: str) -> None:
        local = folder.removeprefix("file://")
        self.log.path = f"{local.rstrip('/')}_queries.jsonl" if "://" not in local else None

    def _replace(self, tables: dict[str, Table]) -> None:
        for name in set(self.tables) - set(tables):
            self.spark.catalog.dropTempView(name)
        self.tables = {}
        for name, t in tables.items():
            self.publish(name, t)

    def dump(self) -> str:
        """A small database as JSON text, cells as {"kind", "v"}; collects all rows."""
        out = {}
        for name, t in self.tables.items():
            rows = t.df.select(*t.kinds).collect() if t.df is not None else []
            cell = lambda k, v: {"kind": int(k) if v is not None else 0, "v": v.isoformat(sep=" ") if isinstance(v, datetime.datetime) else v}
            out[name] = {"schema": {c: int(k) for c, k in t.kinds.items()}, "enums": t.enums, "locked": t.locked, "rows": [{c: cell(k, r[c]) for c, k in t.kinds.items()} for r in rows]}
        return json.dumps(out)

    def restore(self, text: str) -> None:
        """Replaces all tables by those of ``dump``."""
        with self._lock:
            tables = {}
            for name, t in json.loads(text).items():
                kinds = {c: Kind(k) for c, k in t["schema"].items()}
                value = lambda c, v: datetime.datetime.fromisoformat(v) if v is not None and c in kinds and kinds[c] == Kind.DATE else float(v) if isinstance(v, int) and kinds[c] == Kind.FLOAT else v  # noqa: E731, B023
                rows = [(i, *(value(c, r[c]["v"]) for c in kinds)) for i, r in enumerate(t["rows"])]
                df = self.spark.createDataFrame(rows, dml.struct(kinds)) if kinds else None
                tables[name] = Table(df, kinds, t["enums"], t["locked"], len(rows) if kinds else None)
            self._replace(tables)


class Transaction:
    """A snapshot to return to. Writes show at once; rollback puts all tables back as they were."""

    def __init__(self, db: Database):
        self.db, self.open = db, True
        with db._lock:
            self.before = {k: t.but() for k, t in db.tables.items()}
        self.query, self.exec = db.query, db.exec

    def commit(self) -> None:
        self._close()

    def rollback(self) -> None:
        self._close()
        with self.db._lock:
            self.db._replace(self.before)

    def _close(self) -> None:
        if not self.open:
            raise RuntimeError("the transaction is complete")
        self.open = False

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        if self.open:
            self.rollback() if kind else self.commit()

