"""Queries built with the DataFrame API and the column helpers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import functions as S
from ..operators.relational import anti_join, as_of_join, semi_join, top_per_group, union_ragged
from ..streaming.windows import tumbling_counts
from .catalog import frame


@frame("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)")
def df_semi(spark, t):
    return semi_join(t("customer"), t("orders").where("o_totalprice > 400000"), "c_custkey", "o_custkey").select("c_custkey")


@frame("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def df_anti(spark, t):
    return anti_join(t("orders"), t("lineitem"), "o_orderkey", "l_orderkey").select("o_orderkey")


@frame("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) t WHERE n <= 3")
def df_top_per_group(spark, t):
    return top_per_group(t("orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey")


@frame("SELECT p_partkey, CASE WHEN p_size = 25 THEN NULL ELSE p_retailprice / (p_size - 25) END AS q, p_partkey % nullif(CAST(p_size - 25 AS BIGINT), 0) AS m FROM part")
def df_safe_arithmetic(spark, t):
    zero = F.col("p_size") - 25
    return t("part").select("p_partkey", S.safe_div(F.col("p_retailprice"), zero).alias("q"), S.int_mod(F.col("p_partkey"), zero).alias("m"))


@frame("SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH + to_days(CAST(day(o_orderdate) AS INTEGER) - 1) AS DATE) AS d FROM orders")
def date_month_overflow(spark, t):
    return t("orders").select("o_orderkey", S.add_months_overflow(F.col("o_orderdate").cast("date"), 1).alias("d"))


@frame("SELECT count(*) AS n FROM orders WHERE NOT coalesce(nullif(o_orderstatus, 'P') = 'F', false)")
def df_not_2vl(spark, t):
    return t("orders").where(S.not_2vl(F.nullif("o_orderstatus", F.lit("P")) == "F")).agg(F.count(F.lit(1)).alias("n"))


@frame("SELECT o_orderkey, sum(CAST(o_orderkey AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 1000 PRECEDING AND CURRENT ROW)::BIGINT AS s FROM orders")
def df_range_frame(spark, t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rangeBetween(-1000, 0)
    return t("orders").select("o_orderkey", F.sum("o_orderkey").over(w).alias("s"))


@frame("SELECT e.event_id, o.o_orderkey FROM events e ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL) o ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate")
def as_of_bonus(spark, t):
    orders = t("orders").groupBy("o_custkey", "o_orderdate").agg(F.max("o_orderkey").alias("o_orderkey"))
    return as_of_join(t("events"), orders, "user_id", "o_custkey", "ts", "o_orderdate", ["o_orderkey"]).select("event_id", "o_orderkey")


@frame("SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS start, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling_bonus(spark, t):
    return tumbling_counts(t("events"), "ts", "1 hour", ["event_type"])


@frame("SELECT r_regionkey AS k, r_name AS name, CAST(NULL AS INTEGER) AS up FROM region UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT CAST(NULL AS INTEGER), r_name, r_regionkey FROM region")
def df_union_ragged(spark, t):
    regions, nations = t("region"), t("nation")
    first = regions.select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))
    second = nations.select(F.col("n_regionkey").alias("up"), F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return union_ragged(first, second, regions.select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("up")))
