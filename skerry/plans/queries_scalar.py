"""Scalar functions, dates, casts and JSON, most of them in the accepted dialects."""

from __future__ import annotations

from .catalog import both, dialect, pair

both("str_funcs", "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l FROM customer")
both("str_concat", "SELECT c_custkey, c_name || '/' || c_mktsegment AS both_names FROM customer")
pair("str_concat_null", "SELECT o_orderkey, concat('s:', nullif(o_orderstatus, 'P')) AS s FROM orders", "SELECT o_orderkey, 's:' || nullif(o_orderstatus, 'P') AS s FROM orders")
dialect("str_byte_length", "SELECT doc_id, LENGTH(text) AS bytes, CHAR_LENGTH(lang) AS n FROM documents", "SELECT doc_id, CAST(strlen(text) AS INTEGER) AS bytes, CAST(strlen(lang) AS INTEGER) AS n FROM documents")
dialect("math_funcs", "SELECT s_suppkey, ABS(s_acctbal) AS a, FLOOR(s_acctbal) AS f, CEIL(s_acctbal) AS c FROM supplier", "SELECT s_suppkey, abs(s_acctbal) AS a, CAST(floor(s_acctbal) AS BIGINT) AS f, CAST(ceil(s_acctbal) AS BIGINT) AS c FROM supplier")
dialect("round_half_away", "SELECT s_suppkey, ROUND(s_acctbal) AS r, ROUND(s_acctbal, 1) AS r1 FROM supplier", "SELECT s_suppkey, CAST(round(s_acctbal) AS BIGINT) AS r, round(s_acctbal * pow(10, 1)) / pow(10, 1) AS r1 FROM supplier")
dialect("div_by_zero", "SELECT p_partkey, p_partkey / (p_size - 25) AS q FROM part", "SELECT p_partkey, p_partkey / nullif(p_size - 25, 0) AS q FROM part")
dialect("int_div_mod", "SELECT p_partkey, p_partkey DIV (p_size - 25) AS d, p_partkey % (p_size - 25) AS m FROM part", "SELECT p_partkey, p_partkey // nullif(p_size - 25, 0) AS d, p_partkey % nullif(CAST(p_size - 25 AS BIGINT), 0) AS m FROM part")
dialect("arith_mixed", "SELECT p_partkey, 10 / 4 AS q, p_size * 2 - 1 AS a, p_retailprice + p_size AS b FROM part", "SELECT p_partkey, 10 / 4 AS q, p_size * 2 - 1 AS a, p_retailprice + p_size AS b FROM part")
both("null_funcs", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), '?') AS s, nullif(o_orderpriority, '5-LOW') AS p FROM orders")
dialect("ifnull_nvl", "SELECT o_orderkey, IFNULL(NULLIF(o_orderstatus, 'P'), '?') AS s, NVL(NULLIF(o_orderpriority, '5-LOW'), '-') AS p FROM orders", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), '?') AS s, coalesce(nullif(o_orderpriority, '5-LOW'), '-') AS p FROM orders")
pair("date_parts", "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(day(o_orderdate) AS BIGINT) AS d, CAST(hour(o_orderdate) AS BIGINT) AS h, CAST(minute(o_orderdate) AS BIGINT) AS mi, CAST(second(o_orderdate) AS BIGINT) AS s, CAST(weekday(o_orderdate) AS BIGINT) AS wd, CAST(dayofweek(o_orderdate) AS BIGINT) AS dw FROM orders",
     "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, hour(o_orderdate) AS h, minute(o_orderdate) AS mi, second(o_orderdate) AS s, isodow(o_orderdate) - 1 AS wd, dayofweek(o_orderdate) + 1 AS dw FROM orders")
dialect("date_diff", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, DATEDIFF(l_shipdate, DATETIME('1995-01-01')) AS days FROM lineitem", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(date_diff('day', TIMESTAMP '1995-01-01', l_shipdate) AS INTEGER) AS days FROM lineitem")
dialect("ts_diff", "SELECT event_id, TIMESTAMPDIFF('MINUTE', DATETIME('2024-01-01 00:00:00'), ts) AS minutes, TIMESTAMPDIFF('MONTH', DATETIME('2023-11-30'), ts) AS months FROM events", "SELECT event_id, date_sub('minute', TIMESTAMP '2024-01-01', ts) AS minutes, CAST(date_diff('month', TIMESTAMP '2023-11-30', ts) AS INTEGER) AS months FROM events")
dialect("date_add_sub", "SELECT o_orderkey, DATE_ADD(o_orderdate, INTERVAL 3 DAY) AS a, DATE_SUB(o_orderdate, INTERVAL 1 MONTH) AS b, DATE_ADD(o_orderdate, INTERVAL 2 WEEK) AS c, DATE_ADD(o_orderdate, INTERVAL 90 SECOND) AS d FROM orders", "SELECT o_orderkey, o_orderdate + INTERVAL 3 DAY AS a, date_trunc('month', o_orderdate) - INTERVAL 1 MONTH + (o_orderdate - date_trunc('month', o_orderdate)) AS b, o_orderdate + INTERVAL 14 DAY AS c, o_orderdate + INTERVAL 90 SECOND AS d FROM orders")
dialect("date_format", "SELECT event_id, DATE_FORMAT(ts, '%Y-%m-%d %H:%i:%s') AS a, DATE_FORMAT(ts, '%b %e, %y at %I %p') AS b FROM events", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS a, strftime(ts, '%b %-d, %y at %I %p') AS b FROM events")
dialect("date_trunc", "SELECT event_id, DATE(ts) AS d FROM events", "SELECT event_id, date_trunc('day', ts)::TIMESTAMP AS d FROM events")
dialect("cast_numeric", "SELECT s_suppkey, CAST(s_acctbal AS SIGNED) AS i, CAST(s_name AS SIGNED) AS bad, CAST(s_acctbal AS UNSIGNED) AS u, CAST('3.5' AS DOUBLE) AS f FROM supplier", "SELECT s_suppkey, CAST(trunc(s_acctbal) AS BIGINT) AS i, CAST(0 AS BIGINT) AS bad, greatest(CAST(trunc(s_acctbal) AS BIGINT), 0) AS u, 3.5::DOUBLE AS f FROM supplier")
dialect("cast_text", "SELECT p_partkey, CAST(p_size AS CHAR) AS t, CONVERT(p_partkey, CHAR) AS k, p_size::text AS c FROM part", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS t, CAST(p_partkey AS VARCHAR) AS k, CAST(p_size AS VARCHAR) AS c FROM part")
dialect("cast_date", "SELECT o_orderkey, CAST('2024-02-30' AS DATETIME) AS bad, CAST(CONCAT('2024-01-0', o_orderkey % 9 + 1) AS DATETIME) AS good FROM orders", "SELECT o_orderkey, CAST(NULL AS TIMESTAMP) AS bad, CAST('2024-01-0' || (o_orderkey % 9 + 1) AS TIMESTAMP) AS good FROM orders")
dialect("json_extract", "SELECT event_id, CAST(JSON_EXTRACT(props, '$.k') AS SIGNED) AS k FROM events", "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
dialect("json_arrow_text", "SELECT event_id, props->>'$.k' AS k, e.props->>'missing' AS m FROM events e", "SELECT event_id, props->>'$.k' AS k, CAST(NULL AS VARCHAR) AS m FROM events e")
dialect("json_contains", "SELECT event_id FROM events WHERE props @> '{\"k\": 7}'", "SELECT event_id FROM events WHERE CAST(props->>'$.k' AS BIGINT) = 7")
dialect("json_contained", "SELECT count(*) AS n FROM events WHERE '{\"k\": 3}' <@ props", "SELECT count(*) AS n FROM events WHERE CAST(props->>'$.k' AS BIGINT) = 3")
dialect("json_array_length", "SELECT event_id, JSON_ARRAY_LENGTH(CONCAT('[1,', event_id, ']')) AS n, JSON_ARRAY_LENGTH(props) AS none FROM events", "SELECT event_id, CAST(2 AS INTEGER) AS n, CAST(NULL AS INTEGER) AS none FROM events")
dialect("json_keys", "SELECT event_id, JSON_KEYS(props) AS k FROM events", "SELECT event_id, '[\"k\"]' AS k FROM events")
dialect("json_type", "SELECT event_id, JSON_TYPE(props) AS t, JSON_TYPE('[1]') AS a, JSON_TYPE('5') AS s FROM events", "SELECT event_id, 'OBJECT' AS t, 'ARRAY' AS a, 'SCALAR' AS s FROM events")
dialect("json_group", "SELECT props->>'$.k' AS k, COUNT(*) AS n FROM events GROUP BY props->>'$.k'", "SELECT props->>'$.k' AS k, count(*) AS n FROM events GROUP BY props->>'$.k'")
dialect("cast_null", "SELECT o_orderkey, CAST(NULLIF(o_orderstatus, 'P') AS SIGNED) AS i, CAST(NULLIF(o_orderkey % 3, 0) AS UNSIGNED) AS u, CAST(NULLIF(o_orderkey % 4, 1) AS DOUBLE) AS f, o_orderstatus::int AS z FROM orders", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(0 AS BIGINT) END AS i, nullif(o_orderkey % 3, 0) AS u, CAST(nullif(o_orderkey % 4, 1) AS DOUBLE) AS f, CAST(0 AS BIGINT) AS z FROM orders")
dialect("cast_bool", "SELECT o_orderkey, CAST(o_orderkey % 3 AS BOOL) AS n, CAST(o_orderstatus AS BOOL) AS t, CAST(NULLIF(o_orderstatus, 'P') AS BOOL) AS m, CAST('false' AS BOOL) AS w, CAST('' AS BOOL) AS e FROM orders", "SELECT o_orderkey, o_orderkey % 3 <> 0 AS n, true AS t, CASE WHEN o_orderstatus <> 'P' THEN true END AS m, true AS w, false AS e FROM orders")
dialect("cast_time", "SELECT event_id, CAST(ts AS TIME) AS c, CAST(CONCAT(event_id % 24, ':05') AS TIME) AS h, CAST(event_type AS TIME) AS bad, CAST(ts AS SIGNED) AS day FROM events", "SELECT event_id, TIMESTAMP '2000-01-01' + (ts - date_trunc('day', ts)) AS c, TIMESTAMP '2000-01-01 00:05:00' + to_hours(event_id % 24) AS h, CAST(NULL AS TIMESTAMP) AS bad, CAST(strftime(ts, '%Y%m%d') AS BIGINT) AS day FROM events")
dialect("date_add_overflow", "SELECT o_orderkey, DATE_ADD(o_orderdate, INTERVAL 1 MONTH) AS m, DATE_SUB(o_orderdate, INTERVAL 1 YEAR) AS y, DATE_ADD('2024-01-31', INTERVAL 1 MONTH) AS over FROM orders", "SELECT o_orderkey, date_trunc('month', o_orderdate) + INTERVAL 1 MONTH + (o_orderdate - date_trunc('month', o_orderdate)) AS m, date_trunc('month', o_orderdate) - INTERVAL 1 YEAR + (o_orderdate - date_trunc('month', o_orderdate)) AS y, TIMESTAMP '2024-03-02' AS over FROM orders")
dialect("mod_float", "SELECT p_partkey, p_retailprice % 7.9 AS m, p_size * 10 / 7 % 3 AS c, 7.9 % 3 AS k FROM part", "SELECT p_partkey, CAST(trunc(p_retailprice) AS BIGINT) % 7 AS m, CAST(trunc(p_size * 10 / 7) AS BIGINT) % 3 AS c, CAST(1 AS BIGINT) AS k FROM part")
dialect("plus_text", "SELECT n_nationkey, n_name + '-' + n_regionkey AS a, 'x' + n_regionkey * 2 AS b FROM nation", "SELECT n_nationkey, n_name || '-' || n_regionkey AS a, 'x' || (n_regionkey * 2) AS b FROM nation")
dialect("number_literals", "SELECT n_nationkey, n_regionkey + 0x1F AS h, n_regionkey + b'101' AS b, x'0A' AS x FROM nation", "SELECT n_nationkey, n_regionkey + 31 AS h, n_regionkey + 5 AS b, 10 AS x FROM nation")
dialect("date_format_computed", "SELECT event_id, DATE_FORMAT(ts, CONCAT('%Y of ', event_type, ' %H:%i')) AS a FROM events", "SELECT event_id, strftime(ts, '%Y') || ' of ' || event_type || strftime(ts, ' %H:%M') AS a FROM events")
dialect("hash_key_families", "SELECT o.o_orderkey, COUNT(*) AS n FROM orders o JOIN region r ON o.o_orderkey % 2 = r.r_regionkey * 1.0 GROUP BY o.o_orderkey", "SELECT o.o_orderkey, count(*) AS n FROM orders o JOIN region r ON CAST(o.o_orderkey % 2 AS DOUBLE) = r.r_regionkey GROUP BY o.o_orderkey")
#: Documents made of the event's own values, and for each candidate the condition that it means.
DOCS = """CONCAT('{"k": ', event_id % 5, ', "s": "', event_id % 5, '", "t": ', CASE WHEN event_id % 2 = 0 THEN 'true' ELSE '"true"' END, ', "a.b": [', event_id % 3, ', {"c": ', event_id % 4, ', "d": null}], "n": ', event_id % 3, '.0}')"""
CANDIDATES = {
    "num": ('{"k": 2}', "event_id % 5 = 2"),
    "txt": ('{"s": 2}', "false"),
    "str": ('{"s": "2"}', "event_id % 5 = 2"),
    "yes": ('{"t": true}', "event_id % 2 = 0"),
    "arr": ('{"a.b": [1]}', "event_id % 3 = 1"),
    "obj": ('{"a.b": [{"c": 3}]}', "event_id % 4 = 3"),
    "nul": ('{"a.b": [{"d": null}]}', "true"),
    "nest": ('{"a.b": [[1]]}', "false"),
    "flt": ('{"n": 1}', "event_id % 3 = 1"),
    "wrap": ('{"s": ["2"]}', "false"),
    "emp": ("{}", "true"),
    "list": ("[]", "false"),
}
dialect("json_containment", "SELECT event_id, " + ", ".join(f"d @> '{c}' AS {n}" for n, (c, _) in CANDIDATES.items()) + f" FROM (SELECT event_id, {DOCS} AS d FROM events) x", "SELECT event_id, " + ", ".join(f"{w} AS {n}" for n, (_, w) in CANDIDATES.items()) + " FROM events")
dialect("json_unquote", """SELECT event_id, JSON_UNQUOTE(CONCAT('"', event_type, '"')) AS a, JSON_UNQUOTE(event_type) AS b, JSON_UNQUOTE(JSON_EXTRACT(props, '$.k')) AS c FROM events""", "SELECT event_id, event_type AS a, event_type AS b, props->>'$.k' AS c FROM events")
dialect("json_of_rows", """SELECT event_id, JSON_ARRAY_LENGTH(CASE WHEN event_id % 2 = 0 THEN CONCAT('[', event_id, ',2]') ELSE CONCAT('[', event_id, ']') END) AS n, JSON_KEYS(CONCAT('{"', event_type, '":1, "a":', event_id, '}')) AS k, JSON_TYPE(CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN CONCAT('[', event_id, ']') ELSE CAST(event_id AS CHAR) END) AS t FROM events""",
    """SELECT event_id, CAST(CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END AS INTEGER) AS n, '["a","' || event_type || '"]' AS k, CASE event_id % 3 WHEN 0 THEN 'OBJECT' WHEN 1 THEN 'ARRAY' ELSE 'SCALAR' END AS t FROM events""")
