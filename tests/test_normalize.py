from __future__ import annotations

import pytest

from skerry.engine.lint import lint
from skerry.engine.params import bind
from skerry.plans.normalize import SqlError, date_pattern, to_spark


@pytest.mark.parametrize(
    "sql, spark",
    [
        ('SELECT "a b" FROM t', "SELECT `a b` FROM t"),
        ("SELECT 'x \"y\" = ANY(1)' FROM DUAL", "SELECT 'x \"y\" = ANY(1)'"),
        ("SELECT 'it''s'", "SELECT 'it\\'s'"),
        ("SELECT a FROM t LIMIT 5, 10", "SELECT a FROM t LIMIT 10 OFFSET 5"),
        ("a LIKE 'x' ESCAPE ''", "a LIKE 'x'"),
        ("a LIKE 'x!%' ESCAPE '!'", "a LIKE 'x!%' ESCAPE '!'"),
        ("a = ANY(1, 2)", "a  IN (1, 2)"),
        ("a <> ALL(SELECT b FROM u)", "a  NOT IN (SELECT b FROM u)"),
        ("a / b", "a / nullif(b, 0)"),
        ("a % (b + 1)", "(CAST(a AS BIGINT) % nullif(CAST((b + 1) AS BIGINT), 0))"),
        ("t.d->>'$.x'", "get_json_object(t.d, '$.x')"),
        ("LENGTH(x)", "octet_length(x)"),
        ("CAST(x AS CHAR)", "CAST(x AS STRING)"),
        ("x::text", "CAST(x AS STRING)"),
        ("a STRAIGHT_JOIN b ON a.x = b.x", "a FULL OUTER JOIN b ON a.x = b.x"),
        ("COUNT(*) FILTER (WHERE a = 1)", "COUNT(*) FILTER (WHERE a = 1)"),
        ("a -- c 'x\n", "a"),
    ],
)
def test_forms(sql, spark):
    assert to_spark(sql) == spark


def test_unreadable():
    for bad in ("SELECT (", "SELECT )", "a = ALL(1)"):
        with pytest.raises(SqlError):
            to_spark(bad)


def test_date_pattern():
    assert date_pattern("%Y-%m-%d at %H:%i") == "yyyy-MM-dd 'at' HH:mm"


def test_parameters_never_become_text():
    text, args = bind("SELECT :a, ?, ':a'", {"a": "x'; DROP", "p1": [1, 2]})
    assert text == "SELECT :a, :p1_0, :p1_1, ':a'" and args == {"a": "x'; DROP", "p1_0": 1, "p1_1": 2}
    assert bind("x IN (:l)", {"l": []}) == ("x IN (NULL)", {})
    assert bind("$2 $1", ["a", 5]) == (":p2 :p1", {"p2": 5, "p1": "a"})
    with pytest.raises(KeyError):
        bind(":missing", {"a": 1})


def test_lint_masks_strings():
    assert not lint("SELECT 'a :: b RETURNING'", "mysql")
    assert len(lint("SELECT a::int FROM t WHERE x ILIKE 'a' RETURNING", "mysql")) == 3
    assert [w.target for w in lint("SELECT IFNULL(`a`, 1) LIMIT 1, 2", "postgres")] == ["postgres"] * 3
    assert not lint("SELECT 1 -- ILIKE\n /* RETURNING */", "mysql") and not lint("SELECT `returning`, ilike.x FROM t", "generic")
    assert lint("SELECT * FROM (SELECT x::int FROM t) y", "mysql")[0].sql.startswith("SELECT *")
    for sql, target, n in (("SELECT 1 FROM t WHERE a = ANY (1, 2) AND b <> ALL(3)", "mysql", 2), ("SELECT a RLIKE 'x', DATE_FORMAT(d, 'y') FROM t", "postgres", 2), ("SELECT a FROM t ORDER BY a NULLS LAST", "mysql", 1), ("INSERT INTO t (a) VALUES (1) ON CONFLICT (a) DO NOTHING", "mysql", 1), ("SELECT a FROM t LIMIT 5", "postgres", 0)):
        assert len(lint(sql, target)) == n
