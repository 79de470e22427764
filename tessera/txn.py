"""Transactions over versioned tables: snapshot isolation with first-writer-wins, and reads as of a version.

Every statement that writes adds a folder of rows, `<table id>/v=<version>/s=<statement>`, and an entry in the
manifest. Nothing is overwritten. What a transaction sees is a choice of folders: those of versions that were done when
it began, and its own. So visibility costs no work on rows, filters reach the files, and a read of an old version is a
read of fewer folders.

Rows that only add keys ("insert" folders) are read as they are. Folders of updates and deletes ("change") hold the
newest row of a key or mark it as gone; added rows that a newer change covers drop out in an anti join on the key with
the changes, which are few as a rule.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalog import ColumnDef, IndexDef, TableDef
from .errors import AlreadyExistsError, ReadOnlyError, SerializationError, ValueFault
from .sources.store import Store
from .types import SPARK, SQL_NAME

VERSION, STATEMENT, GONE = "__ver", "__seq", "__deleted"


@dataclass(frozen=True)
class TxnState:
    """All that a transaction is; with it a transaction can be taken up again elsewhere."""

    version: int
    read_only: bool
    active: tuple[int, ...]

    def sees(self, version: int) -> bool:
        return version not in self.active and (version < self.version if self.read_only else version <= self.version)


class TxnManager:
    """Begins transactions on a store."""

    def __init__(self, store: Store):
        self.store = store

    def begin(self, read_only: bool = False, as_of: int | None = None) -> Transaction:
        """as_of: the version before whose end to read; its own snapshot tells what was under way then."""
        if as_of is not None and not read_only:
            raise ValueFault("AS OF takes READ ONLY")
        if read_only:
            m = self.store.read()
            if as_of is None:
                return Transaction(self.store, TxnState(m["next_version"], True, tuple(m["active"])))
            if as_of >= m["next_version"] or as_of < 1:
                raise ValueFault(f"there is no version {as_of}")
            return Transaction(self.store, TxnState(as_of, True, tuple(m["snapshots"].get(str(as_of), ()))))

        def take(m: dict) -> TxnState:
            v, active = m["next_version"], tuple(m["active"])
            m["next_version"] = v + 1
            if active:
                m["snapshots"][str(v)] = list(active)
            m["active"] = [*active, v]
            return TxnState(v, False, active)

        return Transaction(self.store, self.store.change(take))

    def resume(self, state: TxnState) -> Transaction:
        if not state.read_only and state.version not in self.store.read()["active"]:
            raise ValueFault(f"transaction {state.version} is over")
        return Transaction(self.store, state)


class Transaction:
    def __init__(self, store: Store, state: TxnState):
        self.store, self.state, self.spark = store, state, store.spark

    @property
    def version(self) -> int:
        return self.state.version

    @property
    def read_only(self) -> bool:
        return self.state.read_only

    # --- end

    def commit(self) -> None:
        if not self.read_only:
            self.store.change(lambda m: m["active"].remove(self.version))

    def rollback(self) -> None:
        if self.read_only:
            return
        folders: list[str] = []

        def undo(m: dict) -> None:
            folders[:] = [w["path"] for w in m["writes"] if w["version"] == self.version]
            m["writes"] = [w for w in m["writes"] if w["version"] != self.version]
            m["catalog"] = [c for c in m["catalog"] if c["version"] != self.version]
            if self.version in m["active"]:
                m["active"].remove(self.version)

        self.store.change(undo)
        for f in folders:
            self.store.remove(f)

    # --- catalog

    def _entry(self, name: str, m: dict) -> dict | None:
        seen = [c for c in m["catalog"] if c["name"] == name and self.state.sees(c["version"])]
        return max(seen, key=lambda c: (c["version"], c["seq"]), default=None)

    def find_table(self, name: str) -> TableDef | None:
        e = self._entry(name, self.store.read())
        return TableDef.from_json(e["table"]) if e and e["table"] else None

    def table(self, name: str) -> TableDef:
        if not (t := self.find_table(name)):
            raise ValueFault(f"no table {name}")
        return t

    def tables(self) -> list[TableDef]:
        m = self.store.read()
        found = (self._entry(n, m) for n in sorted({c["name"] for c in m["catalog"]}))
        return [TableDef.from_json(e["table"]) for e in found if e and e["table"]]

    def _writable(self) -> None:
        if self.read_only:
            raise ReadOnlyError("the transaction is read only")

    def put_table(self, name: str, table: TableDef | None, quiet: bool = False) -> None:
        """A new state of a table's definition; None drops it. quiet: refused where another transaction wrote rows that
        this one can't see."""
        self._writable()

        def put(m: dict) -> None:
            if quiet and table and any(w["table"] == table.id and not self.state.sees(w["version"]) for w in m["writes"]):
                raise SerializationError(f"rows of {name} were written by a concurrent transaction")
            for c in m["catalog"]:
                if c["name"] == name and not self.state.sees(c["version"]):
                    raise SerializationError(f"table {name} was changed by version {c['version']}")
            seq = 1 + sum(c["version"] == self.version for c in m["catalog"])
            m["catalog"].append({"version": self.version, "seq": seq, "name": name, "table": table.to_json() if table else None})

        self.store.change(put)

    def create_table(self, table: TableDef) -> TableDef:
        self._writable()
        if self.find_table(table.name):
            raise AlreadyExistsError(f"there is a table {table.name}")
        table = replace(table, id=uuid.uuid4().hex)
        self.put_table(table.name, table)
        return table

    def create_index(self, table: TableDef, index: IndexDef) -> TableDef:
        """A unique index is refused if rows break it."""
        self._writable()
        new = table.with_index(index)
        if index.unique:
            self._refuse([self._twice(self.snapshot(table), index)])
        self.put_table(table.name, new, quiet=index.unique)
        return new

    # --- rows

    def _writes(self, table: TableDef) -> list[dict]:
        return [w for w in self.store.read()["writes"] if w["table"] == table.id]

    @staticmethod
    def _schema(columns: list[ColumnDef]) -> T.StructType:
        """Of stored files: columns by their ids, and the folders' own."""
        fields = [T.StructField(c.stored, SPARK[c.type]) for c in columns]
        return T.StructType([*fields, T.StructField(GONE, T.BooleanType()), T.StructField("v", T.LongType()), T.StructField("s", T.LongType())])

    def _read(self, table: TableDef, writes: list[dict]) -> DataFrame:
        """Rows of folders under the table's present columns. A column that a folder is too old to have has its
        default there."""
        frames = []
        for had in sorted({tuple(w["columns"]) for w in writes}):
            paths = [w["path"] for w in writes if tuple(w["columns"]) == had]
            have = [c for c in table.columns if c.id in had]
            raw = self.spark.read.schema(self._schema(have)).option("basePath", f"{self.store.root}/data/{table.id}").parquet(*paths)
            cols = [F.col(c.stored).alias(c.name) if c.id in had else F.expr(c.default or f"CAST(NULL AS {SQL_NAME[c.type]})").cast(SPARK[c.type]).alias(c.name) for c in table.columns]
            frames.append(raw.select(*cols, F.col("v").alias(VERSION), F.col("s").alias(STATEMENT), F.col(GONE).alias(GONE)))
        if not frames:
            return self.spark.createDataFrame([], T.StructType([*(T.StructField(c.name, SPARK[c.type]) for c in table.columns), T.StructField(VERSION, T.LongType()), T.StructField(STATEMENT, T.LongType()), T.StructField(GONE, T.BooleanType())]))
        return reduce(DataFrame.union, frames)

    def snapshot(self, table: TableDef) -> DataFrame:
        """The rows that the transaction sees."""
        return self._visible(table, self._writes(table))

    def _visible(self, table: TableDef, writes: list[dict]) -> DataFrame:
        seen = [w for w in writes if self.state.sees(w["version"])]
        names = [c.name for c in table.columns]
        added = self._read(table, [w for w in seen if w["kind"] == "insert"])
        changed = [w for w in seen if w["kind"] == "change"]
        if not changed:
            return added.select(*map(_c, names))
        last = F.row_number().over(Window.partitionBy(*map(_c, table.key)).orderBy(F.col(VERSION).desc(), F.col(STATEMENT).desc(), F.col(GONE)))
        newest = self._read(table, changed).withColumn("__last", last).where("__last = 1")
        marks = newest.select(*(_c(k).alias(f"__key{i}") for i, k in enumerate(table.key)), F.col(VERSION).alias("__v"), F.col(STATEMENT).alias("__s"))
        same = reduce(lambda a, b: a & b, (_c(k) == F.col(f"__key{i}") for i, k in enumerate(table.key)))
        later = (F.col("__v") > F.col(VERSION)) | ((F.col("__v") == F.col(VERSION)) & (F.col("__s") > F.col(STATEMENT)))
        kept = added.join(marks, same & later, "left_anti").select(*map(_c, names))
        return kept.union(newest.where(f"NOT {GONE}").select(*map(_c, names)))

    def get(self, table: TableDef, key: tuple) -> DataFrame:
        """The row of a primary key, or none."""
        if len(key) != len(table.key):
            raise ValueFault("the key's values don't fit its columns")
        return self.snapshot(table).where(reduce(lambda a, b: a & b, (_c(k) == F.lit(v) for k, v in zip(table.key, key, strict=True)))).limit(1)

    def index_get(self, table: TableDef, index: str, key: tuple) -> DataFrame:
        """The rows of an index key; NULL finds NULL."""
        i = self._index(table, index)
        return self.snapshot(table).where(reduce(lambda a, b: a & b, (_c(k).eqNullSafe(F.lit(v)) for k, v in zip(i.columns, key, strict=True))))

    def index_scan(self, table: TableDef, index: str) -> DataFrame:
        """Every key of an index with its rows, as an array of structs."""
        i = self._index(table, index)
        return self.snapshot(table).groupBy(*map(_c, i.columns)).agg(F.collect_list(F.struct("*")).alias("rows"))

    @staticmethod
    def _index(table: TableDef, name: str) -> IndexDef:
        if not (i := table.index(name)):
            raise ValueFault(f"no index {name} on {table.name}")
        return i

    # --- writes

    def _stage(self, table: TableDef, rows: DataFrame, kind: str) -> tuple[dict, DataFrame]:
        """Writes rows (the table's columns and __deleted) into a folder of their own, computed once."""
        seq = 1 + max((w["seq"] for w in self.store.read()["writes"] if w["version"] == self.version), default=0)
        path = f"{self.store.root}/data/{table.id}/v={self.version}/s={seq}"
        rows.select(*(_c(c.name).cast(SPARK[c.type]).alias(c.stored) for c in table.columns), F.col(GONE)).write.mode("overwrite").parquet(path)
        entry = {"table": table.id, "version": self.version, "seq": seq, "kind": kind, "path": path, "columns": [c.id for c in table.columns]}
        return entry, self._read(table, [entry])

    def _adopt(self, table: TableDef, entry: dict, known: set[str]) -> list[dict]:
        """Takes the folder into the state, if all the table's folders there are known. Else returns the others."""

        def take(m: dict) -> list[dict]:
            new = [w for w in m["writes"] if w["table"] == table.id and w["path"] not in known]
            later = [TableDef.from_json(c["table"]) for c in m["catalog"] if c["name"] == table.name and c["table"] and not self.state.sees(c["version"])]
            mine = {i.columns for i in table.indexes if i.unique}
            if any(i.columns not in mine for t in later if t.id == table.id for i in t.indexes if i.unique):
                raise SerializationError(f"a concurrent transaction gave {table.name} a unique index")
            if not new:
                m["writes"].append(entry)
            return new

        return self.store.change(take)

    @staticmethod
    def _unique_of(table: TableDef) -> list[IndexDef]:
        unique = [IndexDef(f"{c.name}", (c.name,), True) for c in table.columns if c.unique] + [i for i in table.indexes if i.unique]
        return list({i.columns: i for i in unique}.values())

    @staticmethod
    def _twice(rows: DataFrame, index: IndexDef) -> tuple[DataFrame, Exception]:
        whole = reduce(lambda a, b: a & b, (_c(c).isNotNull() for c in index.columns))
        twice = rows.where(whole).groupBy(*map(_c, index.columns)).count().where("count > 1")
        return twice, AlreadyExistsError(f"a value of unique index {index.name} is there twice")

    def _faults(self, table: TableDef, staged: DataFrame, replaced: DataFrame | None, writes: list[dict]) -> Iterator[tuple[DataFrame, Exception]]:
        """Rows that must not be, with the error that each kind of them is, in order of precedence. replaced: keys whose
        rows the staged ones take the place of."""
        live = staged.where(f"NOT {GONE}")
        key = list(table.key)
        must = [c.name for c in table.columns if not c.nullable or c.name in key]
        empty = reduce(lambda a, b: a | b, (_c(c).isNull() for c in must))
        yield live.where(empty), ValueFault(f"NULL in a NOT NULL column of {table.name} ({', '.join(must)})")
        yield live.groupBy(*map(_c, key)).count().where("count > 1"), AlreadyExistsError(f"a key of {table.name} is there twice")
        before = self._visible(table, writes)
        if replaced is not None:
            before = before.join(replaced, key, "left_anti")
        yield live.join(before.select(*map(_c, key)), key, "left_semi"), AlreadyExistsError(f"a key of {table.name} is there already")
        for i in self._unique_of(table):
            yield self._twice(before.select(*map(_c, i.columns)).union(live.select(*map(_c, i.columns))), i)

    def _conflicts(self, table: TableDef, staged: DataFrame, writes: list[dict]) -> Iterator[tuple[DataFrame, Exception]]:
        """Rows whose key or unique value stands in folders that the transaction can't see: the first writer wins."""
        hidden = [w for w in writes if not self.state.sees(w["version"])]
        if hidden:
            others = self._read(table, hidden)
            for cols in [list(table.key), *(list(i.columns) for i in self._unique_of(table))]:
                yield staged.join(others.select(*map(_c, cols)), cols, "left_semi"), SerializationError(f"rows of {table.name} were written by a concurrent transaction")

    def _refuse(self, faults: Iterable[tuple[DataFrame, Exception]]) -> None:
        """Raises the first error of those that have rows. All are looked for in one job."""
        found = list(faults)
        if not found:
            return
        marks = reduce(DataFrame.union, (bad.limit(1).select(F.lit(k).alias("k")) for k, (bad, _) in enumerate(found)))
        if (first := marks.agg(F.min("k")).first()[0]) is not None:
            raise found[first][1]

    def _write(self, table: TableDef, rows: DataFrame, kind: str, replaced: DataFrame | None = None) -> DataFrame:
        self._writable()
        entry, staged = self._stage(table, rows, kind)
        try:
            writes = self._writes(table)
            self._refuse([*self._faults(table, staged, replaced, writes), *self._conflicts(table, staged, writes)])
            known = {w["path"] for w in writes}
            while new := self._adopt(table, entry, known):  # written while this was checked: checked against it, too
                self._refuse(self._conflicts(table, staged, new))
                known |= {w["path"] for w in new}
        except Exception:
            self.store.remove(entry["path"])
            raise
        return staged

    def insert(self, table: TableDef, rows: DataFrame) -> int:
        """Adds rows that have the table's columns. Returns their number."""
        return self._write(table, rows.withColumn(GONE, F.lit(False)), "insert").count()

    def update(self, table: TableDef, pairs: DataFrame) -> int:
        """pairs: the table's columns with new values, and the old key as __old0, __old1 and so on. Keys may change."""
        self._writable()
        names = [c.name for c in table.columns]
        entry, both = self._stage_pairs(table, pairs)
        try:
            new = both.select(*map(_c, names)).withColumn(GONE, F.lit(False))
            old = both.select(*(F.col(f"__old{i}").alias(k) for i, k in enumerate(table.key)))
            left = old.join(new.select(*map(_c, table.key)), list(table.key), "left_anti")
            blank = left.select(*(_c(c.name) if c.name in table.key else F.lit(None).cast(SPARK[c.type]).alias(c.name) for c in table.columns), F.lit(True).alias(GONE))
            self._write(table, new.union(blank), "change", replaced=old)
            return both.count()
        finally:
            self.store.remove(entry)

    def _stage_pairs(self, table: TableDef, pairs: DataFrame) -> tuple[str, DataFrame]:
        """New rows beside their old keys, computed once; names in files are neutral."""
        path = f"{self.store.root}/staging/{uuid.uuid4().hex}"
        cols = pairs.columns
        pairs.toDF(*(f"p{i}" for i in range(len(cols)))).write.parquet(path)
        schema = T.StructType([T.StructField(f"p{i}", f.dataType) for i, f in enumerate(pairs.schema.fields)])
        return path, self.spark.read.schema(schema).parquet(path).toDF(*cols)

    def delete(self, table: TableDef, keys: DataFrame) -> int:
        """Removes the rows of these keys (columns named as the key's)."""
        gone = keys.select(*(_c(c.name) if c.name in table.key else F.lit(None).cast(SPARK[c.type]).alias(c.name) for c in table.columns), F.lit(True).alias(GONE))
        return self._write(table, gone, "change").count()

    # --- unversioned values, beside the versions

    def get_meta(self, key: str) -> str | None:
        return self.store.read()["meta"].get(key)

    def set_meta(self, key: str, value: str) -> None:
        self._writable()
        self.store.change(lambda m: m["meta"].update({key: value}))

    def __iter__(self) -> Iterator[int]:
        """(version, read only), as BEGIN shows it."""
        return iter((self.version, self.read_only))


def _c(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")
