"""Statements and expressions as they were written."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..types import Type


class Expr:
    """Any expression."""


@dataclass(frozen=True)
class Literal(Expr):
    value: object  # None, bool, int, float or str


@dataclass(frozen=True)
class Column(Expr):
    name: str
    table: str | None = None


@dataclass(frozen=True)
class Unary(Expr):
    op: str  # NOT, -, +
    arg: Expr


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Is(Expr):
    arg: Expr
    what: str  # NULL, TRUE or FALSE
    negated: bool


@dataclass(frozen=True)
class Like(Expr):
    arg: Expr
    pattern: Expr
    negated: bool
    fold: bool


@dataclass(frozen=True)
class InList(Expr):
    arg: Expr
    items: tuple[Expr, ...]
    negated: bool


@dataclass(frozen=True)
class InQuery(Expr):
    arg: Expr
    query: Select
    negated: bool


@dataclass(frozen=True)
class Exists(Expr):
    query: Select


@dataclass(frozen=True)
class Scalar(Expr):
    query: Select


@dataclass(frozen=True)
class Tuple(Expr):
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]
    star: bool = False


@dataclass(frozen=True)
class Item:
    """An entry of a select list: an expression, or a wildcard of one table or all."""

    expr: Expr | None
    alias: str | None = None
    table: str | None = None


@dataclass(frozen=True)
class Source:
    """A table or a subquery, with the join that brings it in (None for the first)."""

    table: str | None
    query: Select | None
    alias: str | None
    join: str | None = None
    on: Expr | None = None


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]
    sources: tuple[Source, ...]
    where: Expr | None = None
    group: tuple[Expr, ...] = ()
    having: Expr | None = None
    order: tuple[tuple[Expr, bool], ...] = ()  # (expression, descending)
    limit: Expr | None = None
    offset: Expr | None = None


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: Type
    nullable: bool | None = None
    primary_key: bool = False
    unique: bool = False
    default: Expr | None = None


class Statement:
    """Any statement but a query."""


@dataclass(frozen=True)
class Begin(Statement):
    read_only: bool = False
    as_of: int | None = None


@dataclass(frozen=True)
class Commit(Statement):
    pass


@dataclass(frozen=True)
class Rollback(Statement):
    pass


@dataclass(frozen=True)
class CreateTable(Statement):
    name: str
    columns: tuple[ColumnSpec, ...]
    key: tuple[str, ...] = ()
    if_not_exists: bool = False


@dataclass(frozen=True)
class CreateIndex(Statement):
    name: str
    table: str
    columns: tuple[str, ...]
    unique: bool = False
    if_not_exists: bool = False


@dataclass(frozen=True)
class CreateDataset(Statement):
    name: str
    if_not_exists: bool = False


@dataclass(frozen=True)
class DropTable(Statement):
    name: str
    if_exists: bool = False


@dataclass(frozen=True)
class DropIndex(Statement):
    name: str
    table: str
    if_exists: bool = False


@dataclass(frozen=True)
class AddColumn:
    spec: ColumnSpec
    if_not_exists: bool = False


@dataclass(frozen=True)
class DropColumn:
    name: str
    if_exists: bool = False


@dataclass(frozen=True)
class AlterTable(Statement):
    name: str
    actions: tuple[AddColumn | DropColumn, ...]
    if_exists: bool = False


@dataclass(frozen=True)
class Insert(Statement):
    table: str
    columns: tuple[str, ...]
    rows: tuple[tuple[Expr, ...], ...] = ()
    query: Select | None = None


@dataclass(frozen=True)
class Update(Statement):
    table: str
    values: tuple[tuple[str, Expr], ...]
    where: Expr | None = None


@dataclass(frozen=True)
class Delete(Statement):
    table: str
    where: Expr | None = None


@dataclass(frozen=True)
class Explain(Statement):
    statement: Statement | Select
    physical: bool = False
    verbose: bool = False


@dataclass(frozen=True)
class ShowTables(Statement):
    pass


@dataclass(frozen=True)
class ShowCreate(Statement):
    table: str


@dataclass(frozen=True)
class Check(Statement):
    statement: Statement | Select = field()
