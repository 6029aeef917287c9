"""Writes through the database layer; the twin states the expected table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..engine import Database
from .catalog import ORACLE_SQL, QUERIES


def written(name: str, duck_sql: str, *statements: str, select: str, casts: str = "", tables: tuple[str, ...] = ("nation", "region")) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = Database(spark)
        for t in tables:
            db.attach(f"{sf_dir}/{t}.parquet", t)
        out = None
        for s in statements:
            if s == "ENUM":
                db.declare_enum("t", "state", ["new", "old"])
            elif s == "BEGIN":
                tx = db.begin()
            elif s == "ROLLBACK":
                tx.rollback()
            elif " RETURNING " in s:
                out = db.query(s)
            else:
                db.exec(s)
        return out if select == "RETURNING" else db.query(select)

    QUERIES[name] = run
    # Written whole numbers are BIGINT and fractions DOUBLE, whatever the source had.
    ORACLE_SQL[name] = f"SELECT * REPLACE ({casts}) FROM ({duck_sql}) w" if casts else duck_sql


written("dml_insert_values", "SELECT * FROM (VALUES (1, 'a', NULL), (2, NULL, 1.5), (3, 'c', 2.5)) t(id, name, score)",
        "INSERT INTO t (id, name) VALUES (1, 'a')", "INSERT INTO t (id, score) VALUES (2, 1.5)", "INSERT INTO t (id, name, score) VALUES (3, 'c', 2.5)", select="SELECT id, name, score FROM t", casts="CAST(id AS BIGINT) AS id, CAST(score AS DOUBLE) AS score")
written("dml_insert_select", "SELECT n_nationkey AS id, upper(n_name) AS name FROM nation WHERE n_regionkey = 1",
        "INSERT INTO t (id, name) SELECT n_nationkey, UPPER(n_name) FROM nation WHERE n_regionkey = 1", select="SELECT id, name FROM t", casts="CAST(id AS BIGINT) AS id")
written("dml_with_insert", "SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY n_regionkey",
        "WITH c AS (SELECT n_regionkey AS k, COUNT(*) AS n FROM nation GROUP BY n_regionkey) INSERT INTO t (k, n) SELECT k, n FROM c", select="SELECT k, n FROM t", casts="CAST(k AS BIGINT) AS k")
written("dml_upsert_do_update", "SELECT r_regionkey, CASE WHEN r_regionkey = 1 THEN 'ONE' ELSE r_name END AS r_name FROM region UNION ALL SELECT 99, 'NEW'",
        "INSERT INTO region (r_regionkey, r_name) VALUES (1, 'ONE'), (99, 'NEW') ON CONFLICT (r_regionkey) DO UPDATE SET r_name = EXCLUDED.r_name", select="SELECT r_regionkey, r_name FROM region", casts="CAST(r_regionkey AS BIGINT) AS r_regionkey")
written("dml_upsert_repeated", "SELECT * FROM (VALUES (1, 'b', 1), (2, 'c', 3)) t(id, v, n)",
        "INSERT INTO t (id, v, n) VALUES (1, 'a', 1), (1, 'b', 2), (2, 'c', 3) ON CONFLICT (id) DO UPDATE SET v = EXCLUDED.v", select="SELECT id, v, n FROM t", casts="CAST(id AS BIGINT) AS id, CAST(n AS BIGINT) AS n")
written("dml_upsert_do_nothing", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 99, 'NEW'",
        "INSERT INTO region (r_regionkey, r_name) VALUES (1, 'ONE'), (99, 'NEW') ON CONFLICT (r_regionkey) DO NOTHING", select="SELECT r_regionkey, r_name FROM region", casts="CAST(r_regionkey AS BIGINT) AS r_regionkey")
written("dml_upsert_where", "SELECT r_regionkey, CASE WHEN r_regionkey = 2 THEN 'TWO' ELSE r_name END AS r_name FROM region",
        "INSERT INTO region (r_regionkey, r_name) VALUES (1, 'ONE'), (2, 'TWO') ON CONFLICT (r_regionkey) DO UPDATE SET r_name = EXCLUDED.r_name WHERE region.r_name = 'ASIA'", select="SELECT r_regionkey, r_name FROM region", casts="CAST(r_regionkey AS BIGINT) AS r_regionkey")
written("dml_update_expr", "SELECT n_nationkey, n_name || '!' AS n_name, n_regionkey + CASE WHEN n_regionkey = 2 THEN 10 ELSE 0 END AS n_regionkey FROM nation",
        "UPDATE nation SET n_regionkey = n_regionkey + 10 WHERE n_regionkey = 2", "UPDATE nation SET n_name = CONCAT(n_name, '!')", select="SELECT n_nationkey, n_name, n_regionkey FROM nation", casts="CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(n_regionkey AS BIGINT) AS n_regionkey")
written("dml_update_subquery", "SELECT n_nationkey, CASE WHEN n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = 'EUROPE') THEN 'EU' ELSE n_name END AS n_name FROM nation",
        "UPDATE nation SET n_name = 'EU' WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = 'EUROPE')", select="SELECT n_nationkey, n_name FROM nation", casts="CAST(n_nationkey AS BIGINT) AS n_nationkey")
written("dml_delete_where", "SELECT n_nationkey, n_name FROM nation WHERE NOT n_regionkey = 3", "DELETE FROM nation WHERE n_regionkey = 3", select="SELECT n_nationkey, n_name FROM nation", casts="CAST(n_nationkey AS BIGINT) AS n_nationkey")
written("dml_returning_update", "SELECT n_nationkey, n_regionkey + 1 AS moved FROM nation WHERE n_nationkey < 4",
        "UPDATE nation SET n_regionkey = n_regionkey + 1 WHERE n_nationkey < 4 RETURNING n_nationkey, n_regionkey AS moved", select="RETURNING", casts="CAST(moved AS BIGINT) AS moved, CAST(n_nationkey AS BIGINT) AS n_nationkey")
written("dml_returning_delete", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 0", "DELETE FROM nation WHERE n_regionkey = 0 RETURNING n_nationkey, n_name", select="RETURNING", casts="CAST(n_nationkey AS BIGINT) AS n_nationkey")
written("dml_schema_widen", "SELECT * FROM (VALUES (1, 1.0), (2, 2.5)) t(id, v)", "INSERT INTO t (id, v) VALUES (1, 1)", "INSERT INTO t (id, v) VALUES (2, 2.5)", select="SELECT id, v FROM t", casts="CAST(id AS BIGINT) AS id, CAST(v AS DOUBLE) AS v")
written("dml_schema_add_column", "SELECT n_nationkey, CASE WHEN n_nationkey = 100 THEN 'x' END AS extra FROM (SELECT n_nationkey FROM nation UNION ALL SELECT 100) t",
        "INSERT INTO nation (n_nationkey, extra) VALUES (100, 'x')", select="SELECT n_nationkey, extra FROM nation", casts="CAST(n_nationkey AS BIGINT) AS n_nationkey")
written("dml_tx_rollback", "SELECT n_nationkey, n_name FROM nation", "BEGIN", "DELETE FROM nation WHERE n_regionkey = 1", "INSERT INTO nation (n_nationkey) VALUES (500)", "ROLLBACK", select="SELECT n_nationkey, n_name FROM nation")
written("tx_rollback_empty", "SELECT 'old' AS state", "ENUM", "BEGIN", "INSERT INTO t (state) VALUES ('new')", "ROLLBACK", "INSERT INTO t (state) VALUES ('old')", select="SELECT state FROM t")
written("dml_upsert_one_key", "SELECT r_regionkey, CASE WHEN r_regionkey = 1 THEN 'v999' ELSE r_name END AS r_name FROM region",
        "INSERT INTO region (r_regionkey, r_name) VALUES " + ", ".join(f"(1, 'v{k}')" for k in range(1000)) + " ON CONFLICT (r_regionkey) DO UPDATE SET r_name = EXCLUDED.r_name", select="SELECT r_regionkey, r_name FROM region", casts="CAST(r_regionkey AS BIGINT) AS r_regionkey")
written("dml_upsert_select", "SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN (SELECT r_name FROM region WHERE r_regionkey = n_nationkey) ELSE n_name END AS n_name FROM nation",
        "INSERT INTO nation (n_nationkey, n_name) SELECT r_regionkey, r_name FROM region ON CONFLICT (n_nationkey) DO UPDATE SET n_name = EXCLUDED.n_name", select="SELECT n_nationkey, n_name FROM nation", casts="CAST(n_nationkey AS BIGINT) AS n_nationkey")
