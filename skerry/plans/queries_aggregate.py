"""Grouping and aggregates."""

from __future__ import annotations

from .catalog import both, dialect, pair

SUM = "CAST(SUM(CAST({0} AS DECIMAL(18,2))) AS DOUBLE)"
both("agg_global", f"SELECT count(*) AS n, {SUM.format('l_extendedprice')} AS total, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem")
both("agg_group", f"SELECT l_returnflag, l_linestatus, count(*) AS n, {SUM.format('l_quantity')} AS qty FROM lineitem GROUP BY l_returnflag, l_linestatus")
both("agg_sum_int", "SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS size FROM part GROUP BY p_brand")
both("agg_avg", "SELECT o_orderpriority, CAST(avg(CAST(o_custkey AS BIGINT)) AS DOUBLE) AS mean FROM orders GROUP BY o_orderpriority")
both("agg_count_distinct", "SELECT c_mktsegment, count(DISTINCT c_nationkey) AS n FROM customer GROUP BY c_mktsegment")
both("agg_count_null", "SELECT count(nullif(o_orderstatus, 'P')) AS known, count(*) AS n FROM orders")
both("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 12")
both("agg_having_alias", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING n >= 14")
both("agg_having_unprojected", "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING max(o_totalprice) > 450000")
both("agg_filter", "SELECT c_mktsegment, count(*) FILTER (WHERE c_acctbal < 0) AS debt, count(*) AS n FROM customer GROUP BY c_mktsegment")
both("agg_filter_sum", "SELECT o_orderstatus, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderpriority = '5-LOW') AS DOUBLE) AS low FROM orders GROUP BY o_orderstatus")
both("agg_min_max_str", "SELECT p_brand, min(p_name) AS low, max(p_name) AS high FROM part GROUP BY p_brand")
both("agg_min_max_date", "SELECT o_orderstatus, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders GROUP BY o_orderstatus")
both("agg_expr", f"SELECT o_orderstatus, {SUM.format('o_totalprice')} / count(*) AS mean FROM orders GROUP BY o_orderstatus")
both("agg_coalesce", "SELECT s.s_suppkey, coalesce(CAST(sum(l.l_linenumber) AS BIGINT), 0) AS n FROM supplier s LEFT JOIN lineitem l ON s.s_suppkey = l.l_suppkey AND l.l_quantity > 49 GROUP BY s.s_suppkey")
pair("agg_array", "SELECT n_regionkey, concat_ws(',', sort_array(collect_list(n_name))) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(list_sort(list(n_name)), ',') AS names FROM nation GROUP BY n_regionkey")
dialect("agg_array_null", "SELECT n_regionkey, ARRAY_AGG(CASE WHEN n_nationkey > 21 THEN n_nationkey END) IS NULL AS empty FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, max(n_nationkey) <= 21 AS empty FROM nation GROUP BY n_regionkey")
pair("agg_first_in_group", "SELECT o_custkey, min_by(o_orderpriority, o_orderkey) AS first FROM orders GROUP BY o_custkey", "SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS first FROM orders GROUP BY o_custkey")
both("agg_group_expr", "SELECT CAST(year(o_orderdate) AS BIGINT) AS y, count(*) AS n FROM orders GROUP BY year(o_orderdate)")
both("agg_group_ordinal", "SELECT upper(o_orderpriority) AS p, count(*) AS n FROM orders GROUP BY 1")
both("agg_empty_input", "SELECT count(*) AS n, sum(p_retailprice) AS total FROM part WHERE p_size < 0")
both("agg_group_nulls", "SELECT nullif(o_orderstatus, 'P') AS s, count(*) AS n FROM orders GROUP BY nullif(o_orderstatus, 'P')")
both("agg_case_pivot", "SELECT o_custkey, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS f, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS o FROM orders GROUP BY o_custkey")
both("agg_rollup_bonus", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
