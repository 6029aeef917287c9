from __future__ import annotations

import dataclasses
import datetime
import json

import pytest

from skerry.engine import Database, bindings
from skerry.engine.schema import Kind, SchemaError, conflicts, widened
from skerry.plans.normalize import SqlError


@pytest.fixture
def db(spark):
    return Database(spark)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_kinds():
    assert conflicts(Kind.FLOAT, Kind.INT) and conflicts(Kind.INT, Kind.STRING) and conflicts(Kind.DATE, Kind.STRING) and conflicts(Kind.JSON, Kind.INT)
    assert not conflicts(Kind.INT, Kind.FLOAT) and not conflicts(Kind.NULL, Kind.JSON) and widened(Kind.BOOL, Kind.FLOAT) == Kind.FLOAT


def test_inference_and_evolution(db):
    db.exec("INSERT INTO t (id, v) VALUES (1, NULL), (2, 5)")
    db.exec("INSERT INTO t (id, v, extra) VALUES (3, 2.5, 'x')")
    assert db.kinds("t") == {"id": Kind.INT, "v": Kind.FLOAT, "extra": Kind.STRING}
    assert rows(db.query("SELECT * FROM t ORDER BY id")) == [(1, None, None), (2, 5.0, None), (3, 2.5, "x")]
    with pytest.raises(SchemaError):
        db.exec("INSERT INTO t (id) VALUES (9), ('text')")
    assert db.query("SELECT count(*) FROM t").first()[0] == 3  # nothing of a failed write shows
    db.exec("INSERT INTO t (id) VALUES ('text')", force_wipe=True)
    assert rows(db.query("SELECT id FROM t")) == [("text",)]


def test_locks_and_enums(db):
    db.exec("INSERT INTO o (state, qty) VALUES ('new', 1)")
    db.lock_table("o")
    for sql in ("INSERT INTO o (other) VALUES (1)", "INSERT INTO o (qty) VALUES (1.5)"):
        with pytest.raises(SchemaError):
            db.exec(sql)
    db.unlock_table("o")
    db.declare_enum("o", "state", ["new", "done"])
    for sql in ("INSERT INTO o (state) VALUES ('odd')", "UPDATE o SET state = 'odd'"):
        with pytest.raises(SchemaError):
            db.exec(sql)
    with pytest.raises(SchemaError):
        db.declare_enum("o", "state", ["new"])
    db.exec("INSERT INTO o (state) VALUES (NULL)")


def test_upsert_rounds(db):
    db.exec("INSERT INTO k (id, v, n) VALUES (1, 'a', 1), (NULL, 'z', 0)")
    got = db.query("INSERT INTO k (id, v, n) VALUES (1, 'b', 5), (2, 'c', 6), (2, 'd', 7), (NULL, 'y', 1) ON CONFLICT (id) DO UPDATE SET v = EXCLUDED.v RETURNING id, v, n")
    assert rows(got) == [(1, "b", 1), (2, "d", 6), (2, "d", 6), (None, "y", 0)]
    db.exec("INSERT INTO k (id, v) VALUES (1, 'no') ON CONFLICT (id) DO UPDATE SET v = EXCLUDED.v WHERE k.n > 100")
    db.exec("INSERT INTO k (id, v) VALUES (1, 'no'), (8, 'yes') ON CONFLICT (id) DO NOTHING")
    assert rows(db.query("SELECT id, v FROM k WHERE id IN (1, 8) ORDER BY id")) == [(1, "b"), (8, "yes")]


def test_update_sees_earlier_assignments(db):
    db.exec("INSERT INTO u (a, b) VALUES (1, 10), (2, 20)")
    assert rows(db.query("UPDATE u SET a = a + 1, b = a * 100 WHERE a = 1 RETURNING *")) == [(2, 200)]
    assert rows(db.query("DELETE FROM u WHERE b = 20 RETURNING a")) == [(2,)]
    assert rows(db.query("SELECT * FROM u")) == [(2, 200)]


def test_insert_select(db):
    db.exec("INSERT INTO s (id, name) VALUES (1, 'x'), (2, 'y')")
    db.exec("INSERT INTO s (id, name) SELECT id + 10, UPPER(name) FROM s")
    assert rows(db.query("SELECT id, name FROM s ORDER BY id")) == [(1, "x"), (2, "y"), (11, "X"), (12, "Y")]
    for bad in ("INSERT INTO s (id, name) SELECT * FROM s", "INSERT INTO s (id) SELECT id, name FROM s", "INSERT INTO s SELECT id FROM s"):
        with pytest.raises(SqlError):
            db.exec(bad)


def test_transactions(db):
    db.exec("INSERT INTO a (id, balance) VALUES (1, 100)")
    tx = db.begin()
    tx.exec("UPDATE a SET balance = 999")
    tx.exec("INSERT INTO other (x) VALUES (1)")
    assert db.query("SELECT balance FROM a").first()[0] == 999
    tx.rollback()
    assert db.query("SELECT balance FROM a").first()[0] == 100 and "other" not in db.tables
    with pytest.raises(RuntimeError):
        tx.commit()


def test_persistence_and_log(spark, db, tmp_path):
    when = datetime.datetime(2024, 1, 2, 3, 4)
    db.exec("INSERT INTO m (b, i, f, s, d, j, n) VALUES (TRUE, 1, 1.5, 'x', :d, JSON_PARSE('{\"a\": 1}'), NULL)", {"d": when})
    db.declare_enum("m", "s", ["x"])
    db.save(str(tmp_path / "db"))
    db.query("SELECT 1")
    entry = json.loads((tmp_path / "db_queries.jsonl").read_text().splitlines()[-1])
    assert entry["op"] == "query" and entry["error"] == ""
    other = Database(spark)
    other.load(str(tmp_path / "db"))
    third = Database(spark)
    third.restore(db.dump())
    for x in (other, third):
        assert x.kinds("m") == db.kinds("m") and rows(x.table("m")) == rows(db.table("m")) == [(True, 1, 1.5, "x", when, '{"a":1}', None)]
        assert x.tables["m"].enums == {"s": ["x"]}


def test_create_from_dictionaries(db):
    db.create("d", [{"a": 1}, {"a": 2.5, "b": {"x": [1]}}, {"b": None}])
    assert db.kinds("d") == {"a": Kind.FLOAT, "b": Kind.JSON}
    assert rows(db.query("SELECT a, b->>'$.x' AS x FROM d ORDER BY a")) == [(None, None), (1.0, None), (2.5, "[1]")]


def test_ddl(db):
    db.exec("INSERT INTO t (name, id) VALUES ('a', 1)")
    db.declare_enum("t", "name", ["a", "b"])
    assert db.generate_ddl("mysql") == "CREATE TABLE `t` (\n    `id` BIGINT,\n    `name` ENUM('a', 'b')\n);\n"
    assert 'CONSTRAINT "t_name_check" CHECK ("name" IN (\'a\', \'b\'))' in db.generate_ddl("postgres")


def test_dialect_values(db):
    r = db.query("SELECT 5 / 0 AS z, 7 % 0 AS m, ROUND(2.5) AS r, CAST('x' AS SIGNED) AS s, LENGTH('é') AS n, JSON_CONTAINS('[1,2]', '[2]') AS c, JSON_CONTAINS('{\"a\":[1]}', CONCAT('{\"a\":', '[1]}')) AS d").first()
    assert tuple(r) == (None, None, 3, 0, 2, True, True)


def test_bindings(db):
    @dataclasses.dataclass
    class User:
        id: int
        name: str = dataclasses.field(metadata={"db": "user_name"})

    with pytest.raises(bindings.InterfaceError):
        bindings.connect("nowhere")
    bindings.insert_dataclass(db, "users", User(1, "Ann"))
    assert list(bindings.scan_rows(db.table("users"), User)) == [User(1, "Ann")]
    bindings.register(db, "x")
    try:
        con = bindings.connect("x")
        con.begin()
        con.cursor().execute("INSERT INTO users (id, user_name) VALUES (?, ?)", [2, "Bob"])
        assert con.cursor().execute("SELECT id FROM users WHERE id IN (?) ORDER BY id", [[1, 2]]).fetchall() == [(1,), (2,)]
        con.cursor().executemany("INSERT INTO users (id) VALUES (?)", [[3], [4]])
        for sql, error in (("SELECT nothing FROM users", bindings.ProgrammingError), ("INSERT INTO users (id) VALUES ('text')", bindings.IntegrityError)):
            with pytest.raises(error):
                con.cursor().execute(sql)
        con.rollback()
        assert con.cursor().execute("SELECT count(*) FROM users").fetchone() == (1,)
    finally:
        bindings.unregister("x")


def test_nested_dataclasses(db):
    @dataclasses.dataclass
    class Place:
        city: str
        zip_code: str = dataclasses.field(metadata={"db": "zip"})

    @dataclasses.dataclass
    class Person:
        id: int
        home: Place
        work: Place | None = dataclasses.field(default=None, metadata={"db": "-"})
        tags: list = dataclasses.field(default_factory=list, metadata={"to_db": ",".join, "from_db": lambda v: v.split(",") if v else []})

    globals().update(Place=Place)
    someone = Person(1, Place("Rome", "00100"), tags=["a", "b"])
    bindings.insert_dataclass(db, "people", someone)
    assert db.kinds("people") == {"id": Kind.INT, "city": Kind.STRING, "zip": Kind.STRING, "tags": Kind.STRING}
    ((back),) = bindings.scan_rows(db.table("people"), Person)
    assert (back.id, back.home, back.tags) == (someone.id, someone.home, someone.tags)


def test_rollback_hides_what_the_transaction_made(db):
    db.declare_enum("e", "state", ["new"])
    tx = db.begin()
    tx.exec("INSERT INTO e (state) VALUES ('new')")
    assert db.query("SELECT count(*) FROM e").first()[0] == 1
    tx.rollback()
    with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND"):
        db.query("SELECT state FROM e").collect()
    db.exec("INSERT INTO e (state) VALUES ('new')")
    assert db.query("SELECT count(*) FROM e").first()[0] == 1


def test_upsert_of_one_key_in_one_pass(db, monkeypatch):
    from skerry.engine import dml

    passes = []
    one = dml.pass_of
    monkeypatch.setattr(dml, "pass_of", lambda *a: passes.append(1) or one(*a))
    db.exec("INSERT INTO p (id, v, n) VALUES (1, 0, 0)")
    many = ", ".join(f"({k % 2 + 1}, {k}, {k})" for k in range(1000))
    db.exec(f"INSERT INTO p (id, v, n) VALUES {many} ON CONFLICT (id) DO UPDATE SET v = EXCLUDED.v * 2")
    assert len(passes) == 1 and rows(db.query("SELECT id, v, n FROM p ORDER BY id")) == [(1, 1996, 0), (2, 1998, 1)]
    got = db.query("INSERT INTO p (id, v) VALUES (3, 1), (3, 2), (1, 5) ON CONFLICT (id) DO NOTHING RETURNING id, v")
    assert len(passes) == 2 and rows(got) == [(3, 1)]
    # WHERE reads what the tuple before left, and a SET of the key moves the row: one after the other.
    db.exec("INSERT INTO p (id, v) VALUES (3, 10), (3, 20), (3, 5) ON CONFLICT (id) DO UPDATE SET v = EXCLUDED.v WHERE p.v < 10")
    assert rows(db.query("SELECT v FROM p WHERE id = 3")) == [(10,)]
    got = db.query("INSERT INTO p (id, v) VALUES (3, 1), (3, 2) ON CONFLICT (id) DO UPDATE SET id = EXCLUDED.id + 100 RETURNING id, v")
    assert rows(got) == [(103, 10), (3, 2)]


def test_many_small_inserts(db, monkeypatch):
    from skerry.engine import dml

    written = []
    one = dml.stored
    monkeypatch.setattr(dml, "PARTS", 3)
    monkeypatch.setattr(dml, "stored", lambda df, name: written.append(name) or one(df, name))
    db.exec("INSERT INTO q (id) SELECT id FROM range(1000)")
    large = db.tables["q"].parts[0][0]
    for k in range(8):
        db.exec("INSERT INTO q (id) VALUES (:k)", {"k": -k})
    parts = db.tables["q"].parts
    assert parts[0][0] is large and len(parts) <= 3 and sum(n for _, n in parts) == 1008 and len(written) < 15
    assert [r[0] for r in rows(db.query("SELECT id FROM q WHERE id <= 0 ORDER BY id"))] == [*range(-7, 0), 0, 0]
    db.exec("INSERT INTO q (id, more) VALUES (5, 'x')")
    assert db.query("SELECT count(*), count(more) FROM q").first()[:] == (1009, 1)


def test_enums_judge_the_stored_rows(db):
    db.declare_enum("r", "state", ["a"])
    with pytest.raises(SchemaError):
        db.exec("INSERT INTO r (state) SELECT if(rand() < 2, 'b', 'a')")
    assert db.tables["r"].df is None


def test_save_keeps_the_snapshot_before(spark, db, tmp_path):
    """A save that fails half way leaves what was saved last."""
    db.exec("INSERT INTO one (id) VALUES (1)")
    db.exec("INSERT INTO two (id) VALUES (1)")
    db.save(str(tmp_path / "db"))
    db.exec("INSERT INTO one (id) VALUES (2)")
    db.publish("two", dataclasses.replace(db.tables["two"], df=db.tables["two"].df.selectExpr("_rid", "raise_error('broken') AS id")))
    with pytest.raises(Exception, match="broken"):
        db.save(str(tmp_path / "db"))
    other = Database(spark)
    other.load(str(tmp_path / "db"))
    assert rows(other.table("one")) == [(1,)] and rows(other.table("two")) == [(1,)]


def test_log_has_rows_and_errors(db, tmp_path):
    db.exec("INSERT INTO t (id) VALUES (1), (2)")
    db.save(str(tmp_path / "db"))
    assert rows(db.query("SELECT id FROM t ORDER BY id")) == [(1,), (2,)]
    with pytest.raises(SqlError):
        db.exec("SELECT 1")
    first, second = (json.loads(x) for x in (tmp_path / "db_queries.jsonl").read_text().splitlines())
    assert (first["op"], first["rows"], first["error"]) == ("query", 2, "") and second["error"]


def test_casts_of_null_and_dates(db):
    r = db.query("SELECT CAST(NULL AS SIGNED) AS a, CAST(NULL AS UNSIGNED) AS b, CAST(NULL AS DOUBLE) AS c, CAST(' 7 ' AS SIGNED) AS d, CAST(DATE('2024-05-06') AS SIGNED) AS e, CAST('2.5x' AS DOUBLE) AS f, CAST(NULL AS BOOL) AS g, CAST(9007199254740993 AS SIGNED) AS h").first()
    assert tuple(r) == (None, None, None, 7, 20240506, 0.0, None, 9007199254740993)
    with pytest.raises(Exception, match="MALFORMED"):
        db.query("SELECT CAST('{' AS JSON) AS j").collect()


def test_single_values():
    from skerry.engine.values import Value, compare, equal, like_match, make_value, sort_key

    assert [make_value(v).kind for v in (None, True, 3, 2.5, "x", datetime.date(2024, 1, 2), {"a": 1}, (1,))] == [0, 1, 2, 3, 4, 5, 6, 6]
    assert make_value(datetime.date(2024, 1, 2)).v == datetime.datetime(2024, 1, 2) and Value(Kind.NULL).text() == ""
    less = [(None, 0), (False, 1), (1, 1.5), ("a", "b"), ("9", datetime.date(2024, 1, 1)), ("2024-01-01", datetime.date(2024, 1, 2)), (10, "9")]
    assert all(compare(make_value(a), make_value(b)) == -1 and compare(make_value(b), make_value(a)) == 1 for a, b in less)
    assert equal(make_value(1), make_value(1.0)) and equal(make_value(True), make_value(1)) and equal(make_value(None), make_value(None))
    assert [v.v for v in sorted(map(make_value, [2, None, 1.5, True]), key=sort_key)] == [None, True, 1.5, 2]
    assert like_match("a%c_", "abbcd") and like_match("%", "") and not like_match("_", "") and like_match("a.%", "a.\n")
    assert like_match("10!%", "10%", "!") and not like_match("10!%", "100", "!") and not like_match("a!", "a!", "!")


def test_clocks_and_plain_conversions(db):
    today = datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
    r = db.query("SELECT NOW() AS a, CURDATE() AS b, CURTIME() AS c, CURRENT_TIMESTAMP AS d, JSON_PARSE('{ \"a\": [1, 2] }') AS j, CONVERT('é' USING utf8mb4) AS u, CONVERT(5) AS f, SYSDATE() AS s").first()
    assert all(abs((x - today).total_seconds()) < 86400 for x in (r.a, r.c, r.d, r.s)) and r.b.hour == r.b.minute == 0
    assert (r.j, r.u, r.f) == ('{"a":[1,2]}', "é", 5)


def test_as_of_join_over_days(spark):
    from skerry.operators.relational import as_of_join

    t = lambda d, h=0: datetime.datetime(2024, 1, d, h)
    left = spark.createDataFrame([(1, "a", t(1)), (2, "a", t(5, 3)), (3, "a", t(5, 1)), (4, "b", t(9)), (5, None, t(3)), (6, "a", None), (7, "a", t(20)), (8, "b", t(1))], "id int, k string, at timestamp")
    right = spark.createDataFrame([("a", t(2), 10), ("a", t(5, 2), 20), ("b", t(2), 30), (None, t(1), 40), ("a", None, 50), ("b", t(9), None)], "k string, at timestamp, v int")
    got = {r.id: r.v for r in as_of_join(left, right, "k", "k", "at", "at", ["v"]).collect()}
    assert got == {1: None, 2: 20, 3: 10, 4: None, 5: None, 6: None, 7: 20, 8: None}
    assert as_of_join(left.limit(0), right, "k", "k", "at", "at", ["v"]).count() == 0
