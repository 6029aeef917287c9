"""Joins and set operations."""

from __future__ import annotations

from .catalog import both, dialect, pair

MONEY = "CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE)"
both("join_inner", "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 9000")
both("join_left", "SELECT o.o_orderkey, l.l_linenumber, l.l_partkey FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey AND l.l_quantity > 49")
both("join_right", "SELECT l.l_partkey, p.p_partkey FROM lineitem l RIGHT JOIN part p ON l.l_partkey = p.p_partkey AND l.l_quantity > 49")
dialect("join_full", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a FULL OUTER JOIN nation b ON a.n_nationkey = b.n_nationkey + 5")
both("join_cross", "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n")
both("join_comma", "SELECT n.n_name, r.r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey")
both("join_self", "SELECT a.n_name AS first, b.n_name AS second FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
both("join_chain5", f"SELECT r_name, {MONEY} AS total, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY r_name")
both("join_chain_count", "SELECT count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_size < 25")
both("join_non_equi", "SELECT r.r_regionkey AS a, n.n_nationkey AS b FROM region r JOIN nation n ON n.n_nationkey > r.r_regionkey * 5")
both("join_mixed_on", "SELECT o.o_orderkey, l.l_linenumber FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey AND l.l_shipdate > o.o_orderdate AND l.l_quantity > 45")
both("join_left_residual", "SELECT c.c_custkey, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 200000 GROUP BY c.c_custkey")
both("join_many_to_many", "SELECT count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey")
both("join_derived", "SELECT c.c_name, t.n FROM customer c JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) t ON t.o_custkey = c.c_custkey WHERE t.n > 12")
pair("join_using", "SELECT count(*) AS n FROM (SELECT o_orderkey AS k FROM orders) a JOIN (SELECT l_orderkey AS k FROM lineitem) b USING (k)", "SELECT count(*) AS n FROM (SELECT o_orderkey AS k FROM orders) a JOIN (SELECT l_orderkey AS k FROM lineitem) b USING (k)")
both("anti_left_null", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL")
both("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier")
both("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier")
both("union_mixed", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey AS k FROM region UNION SELECT s_nationkey AS k FROM supplier")
both("union_order_limit", "SELECT c_custkey AS k FROM customer UNION ALL SELECT s_suppkey AS k FROM supplier ORDER BY k LIMIT 30")
both("intersect_bonus", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier")
both("except_bonus", "SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey AS k FROM lineitem")
