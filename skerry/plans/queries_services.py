"""The database's services as queries: parameters, snapshots, constraints, mapping, the driver facade, DDL, lint."""

from __future__ import annotations

import dataclasses
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..engine import Database, bindings
from ..engine.lint import lint
from ..engine.schema import SchemaError
from ..storage import shared_dir
from .catalog import ORACLE_SQL, QUERIES
from .normalize import SqlError


def service(duck_sql: str, *tables: str):
    """Registers a function over a database with these tables attached."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            db = Database(spark)
            for t in tables:
                db.attach(f"{sf_dir}/{t}.parquet", t)
            return f(db)

        QUERIES[f.__name__] = run
        ORACLE_SQL[f.__name__] = duck_sql
        return f

    return add


def refused(action, *errors: type[Exception]) -> bool:
    try:
        action()
    except errors:
        return True
    return False


@service("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000 AND o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1997-01-01'", "orders")
def params_named(db):
    import datetime

    sql = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > :low AND o_orderstatus = :status AND o_orderdate >= :since"
    return db.query(sql, {"low": 300000, "status": "F", "since": datetime.date(1997, 1, 1)})


@service("SELECT o_orderkey FROM orders WHERE o_totalprice > 300000 AND o_orderstatus = 'F' UNION ALL SELECT o_orderkey FROM orders WHERE o_orderpriority = '5-LOW' AND o_totalprice < 2000", "orders")
def params_positional(db):
    by_mark = db.query("SELECT o_orderkey FROM orders WHERE o_totalprice > ? AND o_orderstatus = ?", [300000, "F"])
    by_number = db.query("SELECT o_orderkey FROM orders WHERE o_orderpriority = $2 AND o_totalprice < $1", [2000, "5-LOW"])
    return by_mark.unionAll(by_number)


@service("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (1, 3) AND n_nationkey NOT IN (1, 8)", "nation")
def params_lists(db):
    return db.query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (:regions) AND n_nationkey <> ALL(:without)", {"regions": [1, 3], "without": [1, 8]})


@service("SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN 'two' ELSE n_name END AS n_name FROM nation WHERE n_regionkey <> 4", "nation")
def snapshot_files(db):
    """Save, further writes that the snapshot does not have, load into another database."""
    db.exec("UPDATE nation SET n_name = 'two' WHERE n_regionkey = 2")
    db.exec("DELETE FROM nation WHERE n_regionkey = 4")
    folder = f"{shared_dir(db.spark)}/snapshot-{uuid.uuid4().hex}"
    db.save(folder)
    db.exec("DELETE FROM nation")
    other = Database(db.spark)
    other.load(folder)
    other.log.path = None
    return other.query("SELECT n_nationkey, n_name FROM nation")


@service("SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name, CASE WHEN r_regionkey = 0 THEN '{\"k\":0}' END AS doc, CAST(r_regionkey AS DOUBLE) / 2 AS half FROM region", "region")
def snapshot_text(db):
    db.exec("INSERT INTO r (id, name, half) SELECT r_regionkey, r_name, r_regionkey / 2 FROM region")
    db.exec("INSERT INTO r (id, doc) VALUES (0, JSON_PARSE('{\"k\": 0}')) ON CONFLICT (id) DO UPDATE SET doc = EXCLUDED.doc")
    other = Database(db.spark)
    other.restore(db.dump())
    return other.query("SELECT id, name, doc, half FROM r")


@service("SELECT o_orderstatus, count(*) AS n, true AS refused FROM orders GROUP BY o_orderstatus", "orders")
def enum_constraint(db):
    """Values outside the enumeration are refused by every write, and none of the write shows."""
    db.declare_enum("orders", "o_orderstatus", ["F", "O", "P"])
    tries = [
        refused(lambda: db.exec("INSERT INTO orders (o_orderstatus) VALUES ('F'), ('X')"), SchemaError),
        refused(lambda: db.exec("UPDATE orders SET o_orderstatus = 'X' WHERE o_orderkey < 10"), SchemaError),
        refused(lambda: db.declare_enum("orders", "o_orderstatus", ["F", "O"]), SchemaError),
    ]
    return db.query(f"SELECT o_orderstatus, COUNT(*) AS n, {str(all(tries)).lower()} AS refused FROM orders GROUP BY o_orderstatus")


@service("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, true AS refused FROM nation UNION ALL SELECT 100, 'new', true", "nation")
def schema_lock(db):
    db.lock_table("nation")
    tries = [
        refused(lambda: db.exec("INSERT INTO nation (n_nationkey, extra) VALUES (99, 'x')"), SchemaError),
        refused(lambda: db.exec("INSERT INTO nation (n_nationkey) VALUES (1.5)"), SchemaError),
    ]
    db.exec("INSERT INTO nation (n_nationkey, n_name) VALUES (100, 'new')")
    return db.query(f"SELECT n_nationkey, n_name, {str(all(tries)).lower()} AS refused FROM nation")


@service(
    "SELECT table_name AS name, '    \"' || column_name || '\" ' || CASE WHEN column_name = 'r_name' THEN 'TEXT' ELSE CASE data_type WHEN 'VARCHAR' THEN 'TEXT' WHEN 'DOUBLE' THEN 'DOUBLE PRECISION' WHEN 'TIMESTAMP' THEN 'TIMESTAMP' ELSE 'BIGINT' END END AS line"
    " FROM information_schema.columns WHERE table_name IN ('orders', 'region') UNION ALL SELECT 'region', '    CONSTRAINT \"region_r_name_check\" CHECK (\"r_name\" IN (' || string_agg('''' || r_name || '''', ', ' ORDER BY r_name) || '))' FROM region",
    "orders", "region",
)
def ddl_postgres(db):
    """The lines of the generated CREATE TABLE statements."""
    db.declare_enum("region", "r_name", [r[0] for r in db.query("SELECT r_name FROM region ORDER BY r_name").collect()])
    rows, name = [], ""
    for line in db.generate_ddl("postgres").splitlines():
        if line.startswith("CREATE TABLE"):
            name = line.split('"')[1]
        elif line.startswith(" "):
            rows.append((name, line.rstrip(",") if not line.startswith("    CONSTRAINT") else line))
    return db.spark.createDataFrame(rows, "name string, line string")


@service("SELECT * FROM (VALUES ('SELECT a::int FROM t', 'mysql', 1), ('SELECT ''a::int'' FROM t', 'mysql', 0), ('SELECT a FROM t WHERE a ILIKE ''x'' RETURNING', 'mysql', 2), ('SELECT IFNULL(a, 1) FROM t LIMIT 1, 2', 'postgres', 2), ('SELECT a FROM t', 'generic', 0)) v(statement, target, warnings)")
def portability_lint(db):
    cases = [("SELECT a::int FROM t", "mysql"), ("SELECT 'a::int' FROM t", "mysql"), ("SELECT a FROM t WHERE a ILIKE 'x' RETURNING", "mysql"), ("SELECT IFNULL(a, 1) FROM t LIMIT 1, 2", "postgres"), ("SELECT a FROM t", "generic")]
    return db.spark.createDataFrame([(s, t, len(lint(s, t))) for s, t in cases], "statement string, target string, warnings int")


@dataclasses.dataclass
class Region:
    region_key: int = dataclasses.field(metadata={"db": "n_regionkey"})


@dataclasses.dataclass
class Nation:
    key: int = dataclasses.field(metadata={"db": "n_nationkey"})
    region: Region
    name: str = dataclasses.field(metadata={"db": "n_name", "from_db": str.lower, "to_db": str.upper})


@service("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(n_regionkey AS BIGINT) AS n_regionkey, upper(n_name) AS n_name, lower(n_name) AS seen FROM nation", "nation")
def struct_mapping(db):
    """Rows as nested objects and back, with converters."""
    objects = list(bindings.scan_rows(db.table("nation"), Nation))
    db.create("copies", [bindings.flat(o) for o in objects])
    names = db.spark.createDataFrame([(o.key, o.name) for o in objects], "key long, seen string")
    return db.table("copies").join(names, db.table("copies")["n_nationkey"] == names["key"]).select("n_nationkey", "n_regionkey", "n_name", "seen")


@service("SELECT r_name, n FROM (SELECT r_name, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name) t WHERE n >= 1", "region", "nation")
def driver_facade(db):
    """A connection's cursor with parameters; what its transaction wrote is rolled back."""
    name = uuid.uuid4().hex
    bindings.register(db, name)
    try:
        con = bindings.connect(name)
        con.begin()
        con.cursor().executemany("INSERT INTO region (r_regionkey, r_name) VALUES (?, ?)", [[100, "x"], [101, "y"]])
        con.cursor().execute("DELETE FROM nation WHERE n_nationkey > ?", [3])
        con.rollback()
        rows = con.cursor().execute("SELECT r_name, COUNT(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name HAVING COUNT(*) >= ?", [1]).fetchall()
    finally:
        bindings.unregister(name)
    return db.spark.createDataFrame(rows, "r_name string, n long")


@service("SELECT r_regionkey, r_name, true AS refused FROM region", "region")
def unsupported_forms(db):
    """What names no key, no columns or no known column is refused, and nothing is written."""
    tries = [
        refused(lambda s=s: db.exec(s), SqlError)
        for s in (
            "INSERT INTO region (r_regionkey) VALUES (1) ON DUPLICATE KEY UPDATE r_regionkey = 2",
            "INSERT INTO region (r_regionkey, r_name) SELECT * FROM region",
            "INSERT INTO region (r_regionkey, r_regionkey) VALUES (1, 2)",
            "UPDATE region SET nothing = 1",
            "SELECT 1",
        )
    ]
    return db.query(f"SELECT r_regionkey, r_name, {str(all(tries)).lower()} AS refused FROM region")


@service("SELECT event_id, ts < now()::TIMESTAMP AS past, true AS today, CAST(json(props) AS VARCHAR) AS doc, event_type AS kind, event_id AS same FROM events", "events")
def clocks_and_conversions(db):
    return db.query("SELECT event_id, ts < NOW() AS past, CURDATE() <= CURRENT_TIMESTAMP AND DATE(SYSDATE()) = CURRENT_DATE AND CURTIME() >= CURDATE() AS today, JSON_PARSE(props) AS doc, CONVERT(event_type USING utf8mb4) AS kind, CONVERT(event_id) AS same FROM events")
