"""The six logical types, which casts exist between them, and how values are shown."""

from __future__ import annotations

import datetime
import enum

from pyspark.sql import types as T

from .errors import ValueFault


class Type(enum.Enum):
    NULL = "null"
    BOOLEAN = "boolean"
    INTEGER = "integer"
    FLOAT = "float"
    STRING = "string"
    TIMESTAMP = "timestamp"


SPARK = {
    Type.NULL: T.NullType(), Type.BOOLEAN: T.BooleanType(), Type.INTEGER: T.LongType(), Type.FLOAT: T.DoubleType(),
    Type.STRING: T.StringType(), Type.TIMESTAMP: T.TimestampNTZType(),
}
SQL_NAME = {Type.NULL: "VOID", Type.BOOLEAN: "BOOLEAN", Type.INTEGER: "BIGINT", Type.FLOAT: "DOUBLE", Type.STRING: "STRING", Type.TIMESTAMP: "TIMESTAMP_NTZ"}
DDL_NAME = {Type.BOOLEAN: "BOOLEAN", Type.INTEGER: "INTEGER", Type.FLOAT: "DOUBLE", Type.STRING: "TEXT", Type.TIMESTAMP: "TIMESTAMP"}
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"

#: Targets of each type besides itself.
CASTS = {
    Type.NULL: set(Type),
    Type.BOOLEAN: {Type.INTEGER, Type.FLOAT, Type.STRING},
    Type.INTEGER: {Type.BOOLEAN, Type.FLOAT, Type.STRING},
    Type.FLOAT: {Type.BOOLEAN, Type.STRING},
    Type.STRING: {Type.BOOLEAN, Type.TIMESTAMP},
    Type.TIMESTAMP: set(),
}


def of_spark(t: T.DataType) -> Type:
    if isinstance(t, T.NullType):
        return Type.NULL
    if isinstance(t, T.BooleanType):
        return Type.BOOLEAN
    if isinstance(t, T.IntegralType):
        return Type.INTEGER
    if isinstance(t, T.FractionalType):
        return Type.FLOAT
    if isinstance(t, T.StringType):
        return Type.STRING
    if isinstance(t, (T.TimestampNTZType, T.TimestampType)):
        return Type.TIMESTAMP
    raise ValueFault(f"type {t.simpleString()} isn't supported")


def cast_sql(expr: str, source: Type, target: Type) -> str:
    """Spark SQL for an implicit cast; pairs that the matrix hasn't are refused when the statement is planned."""
    if source == target:
        return f"CAST({expr} AS {SQL_NAME[target]})"
    if target not in CASTS[source]:
        raise ValueFault(f"can't cast {source.value} to {target.value}")
    if (source, target) == (Type.STRING, Type.BOOLEAN):
        return f"(length({expr}) > 0)"
    if (source, target) == (Type.STRING, Type.TIMESTAMP):
        return f"to_timestamp_ntz({expr}, '{TIMESTAMP_FORMAT}')"
    if (source, target) == (Type.FLOAT, Type.STRING):  # the shortest text: 2, not 2.0
        return f"regexp_replace(CAST({expr} AS STRING), '\\\\.0$', '')"
    return f"CAST({expr} AS {SQL_NAME[target]})"


def show(value: object) -> str:
    """A value as scripts and tables show it."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, float):
        return f"{value:.2f}"
    if isinstance(value, datetime.datetime):
        return f"'{value:%Y-%m-%d %H:%M:%S}'"
    if isinstance(value, str):
        return f"'{value}'"
    return str(value)
