"""Subqueries, common tables and derived tables."""

from __future__ import annotations

from .catalog import both

both("exists_semi", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)")
both("not_exists_anti", "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
both("exists_or", "SELECT c_custkey FROM customer c WHERE c_acctbal < -900 OR EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 450000)")
both("exists_projected", "SELECT d.doc_id, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AS labelled FROM documents d")
both("exists_uncorrelated", "SELECT r_name FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_regionkey = 99)")
both("in_subquery", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9500)")
both("not_in_subquery", "SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
both("in_group_having", "SELECT c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 14)")
both("in_order_limit", "SELECT p_name FROM part WHERE p_partkey IN (SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20)")
both("in_union", "SELECT n_name FROM nation WHERE n_nationkey IN (SELECT r_regionkey FROM region UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
both("in_distinct", "SELECT n_name FROM nation WHERE n_nationkey IN (SELECT DISTINCT c_nationkey FROM customer WHERE c_acctbal < -990)")
both("in_correlated", "SELECT o.o_orderkey FROM orders o WHERE o.o_orderkey IN (SELECT l.l_orderkey FROM lineitem l WHERE l.l_shipdate > o.o_orderdate AND l.l_quantity > 49)")
both("scalar_uncorrelated", "SELECT p_partkey FROM part WHERE p_size = (SELECT max(p_size) FROM part)")
both("scalar_correlated", "SELECT c.c_custkey, (SELECT max(o.o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS best FROM customer c")
both("scalar_correlated_count", "SELECT o.o_orderkey, (SELECT count(*) FROM lineitem l WHERE l.l_orderkey = o.o_orderkey) AS n FROM orders o")
both("scalar_order_limit", "SELECT r_name, (SELECT n_name FROM nation ORDER BY n_name LIMIT 1) AS first FROM region")
both("scalar_where", "SELECT o.o_orderkey FROM orders o WHERE o.o_totalprice > 4 * (SELECT avg(CAST(i.o_totalprice AS DECIMAL(18,2))) FROM orders i)")
both("scalar_empty", "SELECT r_name, (SELECT n_name FROM nation WHERE n_nationkey = -1) AS nothing FROM region")
both("cte_single", "WITH big AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_totalprice > 300000) SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey")
both("cte_chain", "WITH a AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT n, count(*) AS customers FROM a GROUP BY n) SELECT n, customers FROM b WHERE n > 3")
both("cte_join", "WITH a AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT c.c_mktsegment, CAST(sum(a.n) AS BIGINT) AS n FROM a JOIN customer c ON c.c_custkey = a.o_custkey GROUP BY c.c_mktsegment")
both("cte_union", "WITH u AS (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier) SELECT k, count(*) AS n FROM u GROUP BY k")
both("cte_nested", "WITH outer_cte AS (WITH inner_cte AS (SELECT n_regionkey AS k FROM nation) SELECT k, count(*) AS n FROM inner_cte GROUP BY k) SELECT k, n FROM outer_cte")
both("cte_window", "WITH w AS (SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) SELECT c_custkey FROM w WHERE n <= 2")
both("derived_nested", "SELECT t.k, t.n FROM (SELECT s.k, count(*) AS n FROM (SELECT n_regionkey AS k FROM nation) s GROUP BY s.k) t WHERE t.n > 1")
both("cte_recursive_bonus", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 10) SELECT n FROM t")
