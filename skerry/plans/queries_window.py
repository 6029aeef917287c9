"""Window functions; every order has a unique tiebreaker where it matters."""

from __future__ import annotations

from .catalog import both, pair

W = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
DEC = "CAST(o_totalprice AS DECIMAL(18,2))"
both("win_row_number", f"SELECT o_orderkey, CAST(row_number() {W}) AS BIGINT) AS n FROM orders")
both("win_rank", "SELECT c_custkey, CAST(rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) AS BIGINT) AS r FROM customer")
both("win_dense_rank", "SELECT c_custkey, CAST(dense_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey DESC) AS BIGINT) AS r FROM customer")
both("win_ntile", f"SELECT o_orderkey, CAST(ntile(4) {W}) AS BIGINT) AS q FROM orders")
both("win_cume_dist", "SELECT c_custkey, cume_dist() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) AS d FROM customer")
both("win_percent_rank", "SELECT c_custkey, percent_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) AS d FROM customer")
both("win_lag", f"SELECT o_orderkey, lag(o_orderkey) {W}) AS before FROM orders")
both("win_lead_default", f"SELECT o_orderkey, lead(o_orderkey, 2, CAST(-1 AS BIGINT)) {W}) AS later FROM orders")
both("win_first_last", f"SELECT o_orderkey, first_value(o_orderkey) {W}) AS a, last_value(o_orderkey) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z FROM orders")
both("win_nth_value", f"SELECT o_orderkey, nth_value(o_orderkey, 3) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS third FROM orders")
both("win_running_sum", f"SELECT o_orderkey, CAST(sum({DEC}) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS total FROM orders")
both("win_moving_sum", f"SELECT o_orderkey, CAST(sum({DEC}) {W} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS DOUBLE) AS total FROM orders")
both("win_following", f"SELECT o_orderkey, count(*) {W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS rest FROM orders")
both("win_range_peers", "SELECT c_custkey, count(*) OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM customer")
both("win_range_value", "SELECT c_custkey, count(*) OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey RANGE BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS n FROM customer")
both("win_range_value_desc", "SELECT c_custkey, count(*) OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey DESC RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM customer")
both("win_range_float", "SELECT s_suppkey, count(*) OVER (ORDER BY s_acctbal RANGE BETWEEN 100.5 PRECEDING AND 100.5 FOLLOWING) AS n FROM (SELECT s_suppkey, CAST(s_acctbal AS DECIMAL(12,2)) AS s_acctbal FROM supplier) s")
both("win_default_frame", "SELECT c_custkey, CAST(sum(c_custkey) OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) AS BIGINT) AS total FROM customer")
both("win_partition_total", f"SELECT o_orderkey, CAST(sum({DEC}) OVER (PARTITION BY o_custkey) AS DOUBLE) AS total, CAST(min({DEC}) OVER (PARTITION BY o_custkey) AS DOUBLE) AS low, CAST(max({DEC}) OVER (PARTITION BY o_custkey) AS DOUBLE) AS high FROM orders")
both("win_avg", "SELECT o_orderkey, avg(o_orderkey) OVER (PARTITION BY o_custkey) AS mean FROM orders")
both("win_count_null", "SELECT o_orderkey, count(nullif(o_orderstatus, 'P')) OVER (PARTITION BY o_custkey) AS n FROM orders")
both("win_count_over_limit", "SELECT n_name, count(*) OVER () AS n FROM nation ORDER BY n_name LIMIT 5")
both("win_over_agg", "SELECT o_custkey, count(*) AS n, CAST(rank() OVER (ORDER BY count(*) DESC) AS BIGINT) AS r FROM orders GROUP BY o_custkey")
both("win_top1_cte", f"WITH ranked AS (SELECT o_orderkey, o_custkey, row_number() {W}) AS n FROM orders) SELECT o_orderkey, o_custkey FROM ranked WHERE n = 1")
pair("win_order_alias", "SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS BIGINT) AS n FROM customer ORDER BY n LIMIT 20", "SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS BIGINT) AS n FROM customer ORDER BY n LIMIT 20")
both("win_order_alias_all", "SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS BIGINT) AS n FROM customer ORDER BY n")
pair("win_events_gap", "SELECT event_id, timestampdiff(SECOND, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) AS gap FROM events", "SELECT event_id, date_sub('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) AS gap FROM events")
