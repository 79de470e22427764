"""Scan, project, filter, join, aggregate, sort, limit and subquery predicates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..types import SPARK, Type


def scan(spark: SparkSession, path: str, filters: Sequence[Column] = ()) -> DataFrame:
    """A Parquet table; filters and the columns used later reach the files."""
    df = spark.read.parquet(path)
    return df.where(reduce(lambda a, b: a & b, filters)) if filters else df


def values(spark: SparkSession, columns: Sequence[tuple[str, Type]], rows: Sequence[Sequence[object]]) -> DataFrame:
    from pyspark.sql import types as T

    return spark.createDataFrame(list(map(tuple, rows)), T.StructType([T.StructField(n, SPARK[t]) for n, t in columns]))


def point_read(df: DataFrame, key: dict[str, object]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, (F.col(k) == F.lit(v) for k, v in key.items()))).limit(1)


def project(df: DataFrame, *items: Column | str) -> DataFrame:
    return df.select(*items)


def filter_rows(df: DataFrame, predicate: Column | str) -> DataFrame:
    """Rows for which the predicate is true, and not those for which it is false or NULL."""
    return df.where(predicate)


def join(left: DataFrame, right: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """how: inner, left, right or full. Equal keys and what else `on` says are told apart by Catalyst."""
    if how not in ("inner", "left", "right", "full"):
        raise ValueError(f"no join {how}")
    return left.join(right, on, how)


def semi_join(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    return left.join(right, on, "left_semi")


def anti_join(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    return left.join(right, on, "left_anti")


def exists(df: DataFrame, sub: DataFrame, on: Column) -> DataFrame:
    """Rows for which a row of sub meets `on`."""
    return semi_join(df, sub, on)


def not_exists(df: DataFrame, sub: DataFrame, on: Column) -> DataFrame:
    return anti_join(df, sub, on)


def not_in(df: DataFrame, column: str, sub: DataFrame) -> DataFrame:
    """Rows whose value isn't in sub's only column, by SQL: with a NULL in sub there are none, and a NULL value stays
    only if sub is empty. Catalyst has a null-aware anti join for that form, and no job runs before the plan does."""
    spark, names = df.sparkSession, ("`" + x.replace("`", "``") + "`" for x in (column, sub.columns[0]))
    own, only = names
    return spark.sql(f"SELECT * FROM {{df}} WHERE {own} NOT IN (SELECT {only} FROM {{sub}})", df=df, sub=sub)


def aggregate(df: DataFrame, keys: Sequence[Column | str], *aggs: Column) -> DataFrame:
    """Without keys one row, over no rows too; without aggregates the distinct keys."""
    if not aggs:
        return df.select(*keys).distinct()
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def sort(df: DataFrame, *keys: tuple[str, bool]) -> DataFrame:
    """keys: (column, descending). NULL is lowest."""
    return df.orderBy(*(F.col(k).desc_nulls_last() if d else F.col(k).asc_nulls_first() for k, d in keys))


def limit(df: DataFrame, n: int | None = None, offset: int = 0) -> DataFrame:
    out = df.offset(offset) if offset else df
    return out if n is None else out.limit(n)
