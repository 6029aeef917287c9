"""Scans, projections, predicates, sorting and limits."""

from __future__ import annotations

from .catalog import both, dialect, pair

both("flagship_revenue", """
    SELECT n_name, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS revenue, COUNT(*) AS n_items
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
    WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY n_name""")
both("scan_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 100000")
both("select_star", "SELECT * FROM nation")
both("project_expr", "SELECT p_partkey, p_retailprice * 2 + 1 AS twice, p_size + 1 AS next_size, -p_size AS neg FROM part")
both("qualified_star", "SELECT n.* FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name = 'EUROPE'")
both("distinct_cols", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
dialect("select_no_from", "SELECT 1 + 1 AS two, 'x' AS letter, TRUE AS yes FROM DUAL", "SELECT 1 + 1 AS two, 'x' AS letter, true AS yes")
both("case_searched", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS size FROM orders")
both("case_simple", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders")
dialect("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10, 20", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 10")
both("distinct_limit", "SELECT DISTINCT o_custkey FROM orders ORDER BY o_custkey LIMIT 25")
both("topk_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
both("order_multi_key", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey LIMIT 50")
both("order_by_expr", "SELECT p_partkey, p_size * 2 AS s FROM part ORDER BY p_size * 2 DESC, p_partkey LIMIT 40")
pair("order_nulls", "SELECT o_orderkey, nullif(o_orderstatus, 'P') AS s FROM orders ORDER BY s, o_orderkey LIMIT 60", "SELECT o_orderkey, nullif(o_orderstatus, 'P') AS s FROM orders ORDER BY s NULLS FIRST, o_orderkey LIMIT 60")
both("order_multi_key_all", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey")
both("order_by_expr_all", "SELECT p_partkey, p_size * 2 AS s FROM part ORDER BY p_size * 2 DESC, p_partkey")
pair("order_nulls_all", "SELECT o_orderkey, nullif(o_orderstatus, 'P') AS s FROM orders ORDER BY s, o_orderkey", "SELECT o_orderkey, nullif(o_orderstatus, 'P') AS s FROM orders ORDER BY s NULLS FIRST, o_orderkey")
both("pred_compare", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 12 AND l_linenumber <> 3 AND l_returnflag != 'A'")
both("pred_between", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 50000 AND 60000")
both("pred_not_between", "SELECT o_orderkey FROM orders WHERE o_totalprice NOT BETWEEN 1000 AND 400000")
both("pred_in", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
both("pred_not_in", "SELECT c_custkey FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
both("pred_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%1_'")
both("pred_not_like", "SELECT p_partkey FROM part WHERE p_brand NOT LIKE '%#1%'")
both("pred_like_escape", "SELECT n_nationkey FROM nation WHERE n_name LIKE 'NATION!_1%' ESCAPE '!'")
dialect("pred_like_no_escape", "SELECT n_nationkey FROM nation WHERE n_name LIKE 'NATION_1%' ESCAPE ''", "SELECT n_nationkey FROM nation WHERE n_name LIKE 'NATION_1%'")
dialect("pred_ilike", "SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE 'build%'")
dialect("pred_not_ilike", "SELECT c_custkey FROM customer WHERE c_mktsegment NOT ILIKE '%MACHINE%'")
both("pred_is_null", "SELECT o.o_orderkey FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE l.l_orderkey IS NULL")
both("pred_is_not_null", "SELECT count(*) AS n FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE l.l_orderkey IS NOT NULL")
both("pred_is_true", "SELECT o_orderkey FROM orders WHERE (nullif(o_orderstatus, 'P') = 'F') IS TRUE")
both("pred_is_not_false", "SELECT count(*) AS n FROM orders WHERE (nullif(o_orderstatus, 'P') = 'F') IS NOT FALSE")
both("pred_and_or_not", "SELECT c_custkey FROM customer WHERE (c_acctbal < 0 OR c_mktsegment = 'FURNITURE') AND NOT c_nationkey = 3")
dialect("pred_any_all", "SELECT c_custkey FROM customer WHERE c_nationkey = ANY(1, 2, 3) AND c_mktsegment <> ALL('BUILDING', 'FURNITURE')", "SELECT c_custkey FROM customer WHERE c_nationkey IN (1, 2, 3) AND c_mktsegment NOT IN ('BUILDING', 'FURNITURE')")
dialect("pred_any_subquery", "SELECT c_custkey FROM customer WHERE c_nationkey = ANY(SELECT n_nationkey FROM nation WHERE n_regionkey = 2)", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
both("null_safe_2vl", "SELECT o_orderkey FROM orders WHERE NOT coalesce(nullif(o_orderstatus, 'P') = 'F', false)")
pair("null_safe_equal", "SELECT count(*) AS n FROM orders WHERE nullif(o_orderstatus, 'P') <=> NULL", "SELECT count(*) AS n FROM orders WHERE nullif(o_orderstatus, 'P') IS NOT DISTINCT FROM NULL")
dialect("quoted_names", 'SELECT "o_orderkey" AS "order key" FROM orders WHERE "o_orderstatus" = \'P\'')
both("date_compare", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-03-01' AND o_orderdate < TIMESTAMP '1998-04-01'")
