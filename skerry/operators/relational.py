"""DataFrame operators that compose built-in ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def semi_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of ``left`` with a partner; only the key of ``right`` is read."""
    r = right.select(F.col(right_key).alias("_k"))
    return left.join(r, left[left_key] == r["_k"], "left_semi")


def anti_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, null_safe: bool = False) -> DataFrame:
    """Rows of ``left`` without a partner. ``null_safe``: NULL equals NULL, the two-valued NOT IN."""
    r = right.select(F.col(right_key).alias("_k"))
    same = left[left_key].eqNullSafe(r["_k"]) if null_safe else left[left_key] == r["_k"]
    return left.join(r, same, "left_anti")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark cuts groups before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def union_ragged(first: DataFrame, *rest: DataFrame) -> DataFrame:
    """UNION ALL by name; columns that a side lacks are NULL."""
    for df in rest:
        first = first.unionByName(df, allowMissingColumns=True)
    return first


def as_of_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_time: str, right_time: str, columns: Sequence[str]) -> DataFrame:
    """Each row of ``left`` with the ``columns`` of the latest row of ``right`` of its key that is not later.

    Both sides are unioned and dealt by key and day, so a hot key is spread over its days, and the last right
    row is carried on within each. What a day starts with comes from one row for each key and day: the last
    match of the days before. No pair of rows is made that does not come out. Times are dates or timestamps;
    rows without a time have no match.
    """
    payload = F.struct(*(F.col(c).alias(c) for c in columns))
    kind = right.select(payload.alias("x")).schema[0].dataType
    a = left.select(F.col(left_key).alias("_k"), F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(kind).alias("_match"))
    b = right.select(F.col(right_key).alias("_k"), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), payload.alias("_match")).where("_t IS NOT NULL")
    both = a.unionByName(b).withColumn("_day", F.to_date("_t"))
    within = Window.partitionBy("_k", "_day").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_found", F.last("_match", ignorenulls=True).over(within)).where("_side = 1")
    days = both.groupBy("_k", "_day").agg(F.max_by(F.when(F.col("_side") == 0, F.col("_match")), F.when(F.col("_side") == 0, F.col("_t"))).alias("_last"))
    before = Window.partitionBy("_k").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("_k", "_day", F.last("_last", ignorenulls=True).over(before).alias("_carried")).where("_carried IS NOT NULL")
    found = found.join(days.withColumnsRenamed({"_k": "_dk", "_day": "_dd"}), F.col("_k").eqNullSafe(F.col("_dk")) & (F.col("_day") == F.col("_dd")), "left")
    match = F.when(F.col("_k").isNotNull() & F.col("_t").isNotNull(), F.coalesce("_found", "_carried"))
    return found.withColumn("_match", match).select("_row.*", *(F.col(f"_match.{c}").alias(c) for c in columns))
