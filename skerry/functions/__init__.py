"""Column helpers for semantics that differ from Spark's defaults, all built-in expressions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def safe_div(a: Column, b: Column) -> Column:
    """Quotient as double; NULL for a zero divisor."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def int_mod(a: Column, b: Column) -> Column:
    """Remainder of truncated operands; NULL for a zero divisor."""
    return F.try_mod(a.cast("bigint"), b.cast("bigint"))


def int_div(a: Column, b: Column) -> Column:
    """Whole quotient of integers, towards 0; NULL for a zero divisor."""
    return F.call_function("div", a.cast("bigint"), F.nullif(b.cast("bigint"), F.lit(0)))


def round_half_away(x: Column, n: int | None = None) -> Column:
    """To an integer, or to ``n`` places in floating point."""
    return F.round(x).cast("bigint") if n is None else F.round(x * F.pow(F.lit(10.0), F.lit(n))) / F.pow(F.lit(10.0), F.lit(n))


def byte_length(x: Column) -> Column:
    return F.octet_length(x)


def cast_signed(x: Column) -> Column:
    """Text that is no number counts as 0; NULL stays NULL."""
    return F.when(x.isNotNull(), F.coalesce(x.try_cast("bigint"), F.lit(0).cast("bigint")))


def cast_unsigned(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(cast_signed(x), F.lit(0).cast("bigint")))


def cast_double(x: Column) -> Column:
    return F.when(x.isNotNull(), F.coalesce(x.try_cast("double"), F.lit(0.0)))


def truthy(x: Column, dtype: str) -> Column:
    """Whether a value counts as true: numbers that are not 0, texts that are not empty."""
    if dtype == "boolean":
        return F.coalesce(x, F.lit(False))
    return F.coalesce(x != ("" if dtype == "string" else 0), F.lit(False))


def not_2vl(p: Column) -> Column:
    """NOT in two-valued logic: an unknown predicate counts as false."""
    return ~F.coalesce(p, F.lit(False))


def months_diff(a: Column, b: Column) -> Column:
    """Calendar months from ``a`` to ``b``, days ignored."""
    return (F.year(b) * 12 + F.month(b)) - (F.year(a) * 12 + F.month(a))


def add_months_overflow(d: Column, n: Column | int) -> Column:
    """Adds months; a day past the month's end runs into the next month."""
    return F.date_add(F.add_months(F.trunc(d, "MM"), n), F.day(d) - 1)


def array_agg_or_null(x: Column) -> Column:
    """Values without NULLs, sorted; NULL if there is none."""
    return F.when(F.count(x) > 0, F.sort_array(F.collect_list(x)))


def mysql_date_format(d: Column, fmt: str) -> Column:
    from ..plans.normalize import date_pattern

    return F.date_format(d, date_pattern(fmt))


def json_contains_lit(doc: str, candidate: object) -> Column:
    """Whether the JSON text column ``doc`` contains a literal candidate."""
    from ..plans.normalize import contains

    return F.expr(contains(f"`{doc}`", candidate))


def register_functions(spark: SparkSession) -> None:
    """The one function that needs Python: containment of candidates that are not literals."""

    def contained(doc: object, candidate: object) -> bool:
        if isinstance(candidate, dict):
            return isinstance(doc, dict) and all(k in doc and contained(doc[k], v) for k, v in candidate.items())
        if isinstance(candidate, list):
            return isinstance(doc, list) and all(any(contained(d, w) for d in doc) for w in candidate)
        if isinstance(candidate, bool) or isinstance(doc, bool):
            return doc is candidate
        return doc == candidate if isinstance(doc, type(candidate)) or isinstance(doc, (int, float)) and isinstance(candidate, (int, float)) else False

    def json_contains(docs: pd.Series, candidates: pd.Series) -> pd.Series:
        def one(doc: str | None, candidate: str | None) -> bool:
            try:
                wanted = json.loads(candidate) if doc is not None and candidate is not None else None
                return wanted is not None and contained(json.loads(doc), wanted)
            except ValueError:
                return False

        return pd.Series([one(d, c) for d, c in zip(docs, candidates, strict=True)])

    spark.udf.register("skerry_json_contains", F.pandas_udf(json_contains, "boolean"))
