"""Tables, columns and indexes as the catalog knows them."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

from .errors import AlreadyExistsError, ValueFault
from .sql import printer
from .types import DDL_NAME, Type


@dataclass(frozen=True)
class ColumnDef:
    """A column. Its id names it in files, so names can be dropped and used again. default: Spark SQL of a constant."""

    id: int
    name: str
    type: Type
    nullable: bool = True
    default: str | None = None
    default_text: str | None = None  # as written
    unique: bool = False

    @property
    def stored(self) -> str:
        return f"c{self.id}"


@dataclass(frozen=True)
class IndexDef:
    name: str
    columns: tuple[str, ...]
    unique: bool = False
    implied: bool = False  # of a UNIQUE column


@dataclass(frozen=True)
class TableDef:
    id: str
    name: str
    columns: tuple[ColumnDef, ...]
    key: tuple[str, ...]
    indexes: tuple[IndexDef, ...] = ()
    next_column: int = field(default=0)

    def __post_init__(self) -> None:
        names = [c.name for c in self.columns]
        if not self.name or not names:
            raise ValueFault("a table has a name and at least one column")
        if len(set(names)) < len(names):
            raise ValueFault("a column's name is there twice")
        if not self.key:
            raise ValueFault(f"table {self.name} has no primary key")
        if len(set(self.key)) < len(self.key) or set(self.key) - set(names):
            raise ValueFault(f"the primary key of {self.name} doesn't fit its columns")

    def column(self, name: str) -> ColumnDef:
        for c in self.columns:
            if c.name == name:
                return c
        raise ValueFault(f"table {self.name} has no column {name}")

    def index(self, name: str) -> IndexDef | None:
        return next((i for i in self.indexes if i.name == name), None)

    def with_index(self, index: IndexDef) -> TableDef:
        if self.index(index.name):
            raise AlreadyExistsError(f"there is an index {index.name} on {self.name}")
        for c in index.columns:
            self.column(c)
        return replace(self, indexes=(*self.indexes, index))

    def ddl(self) -> str:
        """CREATE TABLE, and CREATE INDEX for each index that a column doesn't imply."""
        cols = []
        for c in self.columns:
            own = self.key == (c.name,)
            text = f"  {printer.name(c.name)} {DDL_NAME[c.type]}" + " PRIMARY KEY" * own + " NOT NULL" * (not c.nullable) + " UNIQUE" * c.unique
            cols.append(text + (f" DEFAULT {c.default_text}" if c.default_text is not None else ""))
        if len(self.key) > 1:
            cols.append(f"  PRIMARY KEY ({', '.join(map(printer.name, self.key))})")
        out = [f"CREATE TABLE {printer.name(self.name)} (\n" + ",\n".join(cols) + "\n);"]
        for i in self.indexes:
            if not i.implied:
                out.append(f"CREATE {'UNIQUE ' * i.unique}INDEX {printer.name(i.name)} ON {printer.name(self.name)} ({', '.join(map(printer.name, i.columns))});")
        return "\n".join(out)

    def to_json(self) -> dict:
        return asdict(self) | {"columns": [asdict(c) | {"type": c.type.value} for c in self.columns]}

    @staticmethod
    def from_json(d: dict) -> TableDef:
        return TableDef(
            d["id"], d["name"], tuple(ColumnDef(**c | {"type": Type(c["type"])}) for c in d["columns"]), tuple(d["key"]),
            tuple(IndexDef(i["name"], tuple(i["columns"]), i["unique"], i["implied"]) for i in d["indexes"]), d["next_column"],
        )
