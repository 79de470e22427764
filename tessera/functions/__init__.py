"""Scalar and aggregate functions, built in and registered."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from ..errors import AlreadyExistsError, ValueFault
from ..types import SPARK, Type


@dataclass(frozen=True)
class Function:
    """A function by name. args: the types of its arguments, None where any will do. spark: its name in Spark SQL."""

    name: str
    args: tuple[Type | None, ...]
    returns: Type
    spark: str
    aggregate: bool = False
    star: bool = False  # takes *


BUILTIN = (
    Function("upper", (Type.STRING,), Type.STRING, "upper"),
    Function("count", (None,), Type.INTEGER, "count", aggregate=True, star=True),
)


class Registry:
    """Functions that a session knows: scalars and aggregates share one space of names."""

    def __init__(self) -> None:
        self.functions: dict[str, Function] = {f.name: f for f in BUILTIN}

    def find(self, name: str) -> Function:
        if name not in self.functions:
            raise ValueFault(f"no function {name}")
        return self.functions[name]

    def check(self, name: str, args: Sequence[Type], star: bool) -> Function:
        f = self.find(name)
        if star:
            if not f.star:
                raise ValueFault(f"{name}(*) makes no sense")
            return f
        if len(args) != len(f.args):
            raise ValueFault(f"{name} takes {len(f.args)} arguments, not {len(args)}")
        for want, got in zip(f.args, args, strict=True):
            if want and got not in (want, Type.NULL) and (want, got) != (Type.FLOAT, Type.INTEGER):
                raise ValueFault(f"{name} takes {want.value}, not {got.value}")
        return f

    def _add(self, f: Function) -> None:
        if f.name in self.functions:
            raise AlreadyExistsError(f"there is a function {f.name}")
        self.functions[f.name] = f

    def register_scalar(self, spark, name: str, fn: Callable, args: Sequence[Type], returns: Type) -> None:
        """fn takes and gives pandas Series; it runs on Arrow batches."""
        from pyspark.sql.functions import pandas_udf

        self._add(Function(name, tuple(args), returns, f"tessera_{name}"))
        spark.udf.register(f"tessera_{name}", pandas_udf(fn, returnType=SPARK[returns]))

    def register_aggregate(self, spark, name: str, fn: Callable, args: Sequence[Type], returns: Type) -> None:
        """fn takes a group's values as pandas Series and gives one value."""
        from pyspark.sql.functions import PandasUDFType, pandas_udf

        self._add(Function(name, tuple(args), returns, f"tessera_{name}", aggregate=True))
        spark.udf.register(f"tessera_{name}", pandas_udf(fn, returnType=SPARK[returns], functionType=PandasUDFType.GROUPED_AGG))
