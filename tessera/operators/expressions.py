"""Expressions whose meaning Spark's own don't have in one call."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import Type, cast_sql, of_spark


def _name(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def div(df: DataFrame, a: str, b: str) -> Column:
    """a / b by the types of two expressions over df: whole numbers divide towards zero."""
    kinds = [of_spark(f.dataType) for f in df.selectExpr(f"{a} AS a", f"{b} AS b").schema.fields]
    if all(k in (Type.INTEGER, Type.NULL) for k in kinds):
        return F.expr(f"({a}) div ({b})")
    return F.expr(f"CAST(({a}) AS DOUBLE) / ({b})")


def is_true(c: Column, negated: bool = False) -> Column:
    out = c.eqNullSafe(F.lit(True))
    return ~out if negated else out


def is_false(c: Column, negated: bool = False) -> Column:
    out = c.eqNullSafe(F.lit(False))
    return ~out if negated else out


def in_list(c: Column, values: Sequence[object], negated: bool = False) -> Column:
    out = c.isin(*values)
    return ~out if negated else out


def like(c: Column, pattern: str | Column, negated: bool = False, fold: bool = False) -> Column:
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    out = F.ilike(c, p) if fold else F.like(c, p)
    return ~out if negated else out


def cast_to(df: DataFrame, column: str, target: Type) -> Column:
    """A cast of the matrix; a pair that it hasn't is refused here."""
    return F.expr(cast_sql(_name(column), of_spark(df.schema[column].dataType), target))
