"""Sessions: statements in, DataFrames out."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from contextlib import contextmanager
from dataclasses import replace

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from .catalog import ColumnDef, IndexDef, TableDef
from .errors import AlreadyExistsError, UnimplementedError, ValueFault
from .functions import Registry
from .sources import tpcc
from .sources.store import Store
from .sql import ast as A
from .sql import printer
from .sql.binder import Binder, Scope, quote
from .sql.parser import parse_statement, parse_statements
from .txn import Transaction, TxnManager
from .types import SQL_NAME, Type, cast_sql, of_spark


class Session:
    """A line of statements on a store.

    Reads give lazy DataFrames over files that never change, so a result stays what it was when its statement ran.
    Outside BEGIN and COMMIT a query reads in a read-only transaction, and any other statement commits or rolls back
    on its own."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.store = Store(spark, root)
        self.manager = TxnManager(self.store)
        self.registry = Registry()
        self.txn: Transaction | None = None
        self.external: dict[str, DataFrame] = {}

    # --- API

    def execute(self, sql: str) -> DataFrame:
        return self.run(parse_statement(sql))

    def execute_script(self, sql: str) -> list[DataFrame]:
        return [self.run(s) for s in parse_statements(sql)]

    def table(self, name: str) -> DataFrame:
        with self._reading() as txn:
            return self._rows(txn, name)

    def attach(self, name: str, rows: DataFrame) -> None:
        """Makes a DataFrame readable as a table. It has no versions and can't be written."""
        self.external[name] = rows

    def register_scalar(self, name: str, fn: Callable, args: Sequence[Type], returns: Type) -> None:
        self.registry.register_scalar(self.spark, name, fn, args, returns)

    def register_aggregate(self, name: str, fn: Callable, args: Sequence[Type], returns: Type) -> None:
        self.registry.register_aggregate(self.spark, name, fn, args, returns)

    # --- transactions

    def run(self, s: A.Statement | A.Select) -> DataFrame:
        try:
            return self._run(s)
        except PySparkException as e:
            raise ValueFault(str(e).split("\n")[0]) from e

    def _run(self, s: A.Statement | A.Select) -> DataFrame:
        if isinstance(s, A.Begin):
            if self.txn:
                raise ValueFault("already in a transaction")
            self.txn = self.manager.begin(s.read_only, s.as_of)
            return self._state(self.txn)
        if isinstance(s, (A.Commit, A.Rollback)):
            if not self.txn:
                raise ValueFault("not in a transaction")
            txn, self.txn = self.txn, None
            txn.commit() if isinstance(s, A.Commit) else txn.rollback()
            return self._state(txn)
        if isinstance(s, (A.Select, A.Explain, A.ShowTables, A.ShowCreate, A.Check)):
            with self._reading() as txn:
                return self._read(txn, s)
        if self.txn:
            return self._change(self.txn, s)
        txn = self.manager.begin()
        try:
            out = self._change(txn, s)
        except BaseException:
            txn.rollback()
            raise
        txn.commit()
        return out

    @contextmanager
    def _reading(self):
        yield self.txn or self.manager.begin(read_only=True)

    def _frame(self, rows: list[tuple], ddl: str) -> DataFrame:
        return self.spark.createDataFrame(rows, ddl)

    def _state(self, txn: Transaction) -> DataFrame:
        return self._frame([(txn.version, txn.read_only)], "version long, read_only boolean")

    # --- reading

    def _rows(self, txn: Transaction, name: str) -> DataFrame:
        if (t := txn.find_table(name)) is None and name in self.external:
            return self.external[name]
        return txn.snapshot(t or txn.table(name))

    @contextmanager
    def _binder(self, txn: Transaction):
        """A binder whose tables are views, for as long as it takes Spark to read the names in a text."""
        views: dict[str, tuple[str, list]] = {}

        def resolve(name: str) -> tuple[str, list]:
            if name not in views:
                rows = self._rows(txn, name)
                view = f"tessera_{uuid.uuid4().hex}"
                rows.createOrReplaceTempView(view)
                views[name] = (view, [(f.name, of_spark(f.dataType)) for f in rows.schema.fields])
            return views[name]

        try:
            yield Binder(resolve, self.registry)
        finally:
            for view, _ in views.values():
                self.spark.catalog.dropTempView(view)

    def _query(self, txn: Transaction, q: A.Select) -> tuple[DataFrame, list[tuple[str, Type]]]:
        with self._binder(txn) as b:
            text, cols = b.select(q)
            return self.spark.sql(text), cols

    def _read(self, txn: Transaction, s: A.Statement | A.Select) -> DataFrame:
        if isinstance(s, A.Select):
            return self._query(txn, s)[0]
        if isinstance(s, A.ShowTables):
            return self._frame([(t.name,) for t in txn.tables()], "tables string")
        if isinstance(s, A.ShowCreate):
            return self._frame([(txn.table(s.table).ddl(),)], "create_table_stmt string")
        if isinstance(s, A.Check):
            return self._frame([(printer.statement(s.statement),)], "parsed_sql string")
        assert isinstance(s, A.Explain)
        return self._explain(txn, s)

    def _explain(self, txn: Transaction, s: A.Explain) -> DataFrame:
        """The plans of the query, or of the rows that a statement would write."""
        inner = s.statement
        if isinstance(inner, A.Select):
            df = self._query(txn, inner)[0]
        elif isinstance(inner, A.Insert):
            df = self._new_rows(txn, txn.table(inner.table), inner)
        elif isinstance(inner, A.Update):
            df = self._updated(txn, txn.table(inner.table), inner)
        elif isinstance(inner, A.Delete):
            df = self._matching(txn, txn.table(inner.table), inner.where)
        else:
            return self._frame([("logical plan", printer.statement(inner))], "type string, plan string")
        plans = df._jdf.queryExecution()
        rows = [("logical plan", plans.optimizedPlan().toString())]
        if s.verbose:
            rows[0] = ("logical plan", rows[0][1] + "\nSchema: " + df.schema.simpleString())
        if s.physical:
            rows.append(("physical plan", plans.executedPlan().toString()))
        return self._frame(rows, "type string, plan string")

    # --- changing

    def _change(self, txn: Transaction, s: A.Statement) -> DataFrame:
        if isinstance(s, A.Insert):
            t = txn.table(s.table)
            return self._count(txn.insert(t, self._new_rows(txn, t, s)))
        if isinstance(s, A.Update):
            t = txn.table(s.table)
            return self._count(txn.update(t, self._updated(txn, t, s)))
        if isinstance(s, A.Delete):
            t = txn.table(s.table)
            return self._count(txn.delete(t, self._matching(txn, t, s.where).select(*(quote(k) for k in t.key))))
        if isinstance(s, A.CreateTable):
            return self._create_table(txn, s)
        if isinstance(s, A.CreateDataset):
            return self._create_dataset(txn, s)
        if isinstance(s, A.CreateIndex):
            t = txn.table(s.table)
            if t.index(s.name) and s.if_not_exists:
                return self._named("index", s.name)
            txn.create_index(t, IndexDef(s.name, s.columns, s.unique))
            return self._named("index", s.name)
        if isinstance(s, A.DropTable):
            if txn.find_table(s.name) or not s.if_exists:
                txn.put_table(txn.table(s.name).name, None)
            return self._named("table", s.name)
        if isinstance(s, A.DropIndex):
            t = txn.table(s.table)
            found = t.index(s.name)
            if not found and not s.if_exists:
                raise ValueFault(f"no index {s.name} on {s.table}")
            if found:
                cols = tuple(replace(c, unique=False) if found.implied and (c.name,) == found.columns else c for c in t.columns)
                txn.put_table(t.name, replace(t, columns=cols, indexes=tuple(i for i in t.indexes if i.name != s.name)))
            return self._named("index", s.name)
        if isinstance(s, A.AlterTable):
            return self._alter(txn, s)
        raise UnimplementedError(f"{type(s).__name__} isn't a statement to run")

    def _count(self, n: int) -> DataFrame:
        return self._frame([(n,)], "count long")

    def _named(self, what: str, name: str) -> DataFrame:
        return self._frame([(name,)], f"{what} string")

    def _column(self, spec: A.ColumnSpec, n: int, key: tuple[str, ...]) -> ColumnDef:
        part = spec.name in key
        if part and spec.nullable:
            raise ValueFault(f"{spec.name} is of the primary key and can't be NULL")
        default = text = None
        if spec.default is not None:
            sql, kind = Binder(self._no_tables, self.registry).expr(spec.default, Scope([]))
            if kind == Type.NULL and (part or spec.nullable is False):
                raise ValueFault(f"{spec.name} can't be NULL, so NULL is no default")
            default, text = cast_sql(sql, kind, spec.type), printer.expr(spec.default)
            self.spark.range(1).selectExpr(default).collect()  # a constant that doesn't compute is refused now
        return ColumnDef(n, spec.name, spec.type, not part and spec.nullable is not False, default, text, spec.unique and key != (spec.name,))

    @staticmethod
    def _no_tables(name: str):
        raise ValueFault("a default is a constant")

    def _create_table(self, txn: Transaction, s: A.CreateTable) -> DataFrame:
        if txn.find_table(s.name) and s.if_not_exists:
            return self._named("table", s.name)
        inline = tuple(c.name for c in s.columns if c.primary_key)
        if len(inline) > 1 or inline and s.key:
            raise ValueFault("a table has one primary key; for several columns, name them together")
        key = s.key or inline
        cols = tuple(self._column(c, k, key) for k, c in enumerate(s.columns))
        implied = tuple(IndexDef(f"c{c.id}", (c.name,), True, True) for c in cols if c.unique)
        txn.create_table(TableDef("", s.name, cols, key, implied, len(cols)))
        return self._named("table", s.name)

    def _alter(self, txn: Transaction, s: A.AlterTable) -> DataFrame:
        if s.if_exists and not txn.find_table(s.name):
            return self._named("table", s.name)
        t = txn.table(s.name)
        for a in s.actions:
            if isinstance(a, A.AddColumn):
                if any(c.name == a.spec.name for c in t.columns):
                    if a.if_not_exists:
                        continue
                    raise AlreadyExistsError(f"there is a column {a.spec.name}")
                if a.spec.primary_key:
                    raise ValueFault("a primary key is declared with its table")
                c = self._column(a.spec, t.next_column, t.key)
                if not c.nullable and c.default is None and txn.snapshot(t).limit(1).count():
                    raise ValueFault(f"{c.name} can't be NULL and has no default for the rows there are")
                t = replace(t, columns=(*t.columns, c), next_column=t.next_column + 1)
                if c.unique:
                    t = t.with_index(IndexDef(f"c{c.id}", (c.name,), True, True))
                    if c.default is not None and txn.snapshot(t).limit(2).count() > 1:
                        raise ValueFault(f"{c.name} is UNIQUE, so rows can't share its default")
            else:
                if not any(c.name == a.name for c in t.columns):
                    if a.if_exists:
                        continue
                    t.column(a.name)
                if a.name in t.key:
                    raise ValueFault(f"{a.name} is of the primary key")
                t = replace(t, columns=tuple(c for c in t.columns if c.name != a.name), indexes=tuple(i for i in t.indexes if a.name not in i.columns))
        txn.put_table(t.name, t)
        return self._named("table", s.name)

    def _create_dataset(self, txn: Transaction, s: A.CreateDataset) -> DataFrame:
        if s.name != "tpcc":
            raise ValueFault(f"no dataset {s.name}")
        made = 0
        for name in tpcc.TABLES:
            stmt = parse_statement(tpcc.ddl(name))
            assert isinstance(stmt, A.CreateTable)
            if s.if_not_exists and txn.find_table(stmt.name):
                continue
            self._create_table(txn, stmt)
            made += txn.insert(txn.table(stmt.name), tpcc.generate(self.spark, stmt.name))
        return self._count(made)

    # --- rows that statements write

    def _new_rows(self, txn: Transaction, t: TableDef, s: A.Insert) -> DataFrame:
        """The table's columns: values given, cast by the matrix, and defaults for the rest."""
        if len(set(s.columns)) < len(s.columns):
            raise ValueFault("a column is named twice")
        targets = [t.column(c) for c in s.columns]
        if s.query:
            df, cols = self._query(txn, s.query)
            if len(cols) != len(targets):
                raise ValueFault(f"{len(targets)} columns, {len(cols)} values")
            df = df.toDF(*(f"v{k}" for k in range(len(cols))))
            given = {c.name: cast_sql(f"v{k}", kind, c.type) for k, (c, (_, kind)) in enumerate(zip(targets, cols, strict=True))}
            return df.selectExpr(*(f"{self._value(t, c, given)} AS {quote(c.name)}" for c in t.columns))
        with self._binder(txn) as b:
            rows = []
            for r in s.rows:
                if len(r) != len(targets):
                    raise ValueFault(f"{len(targets)} columns, {len(r)} values")
                rows.append("(" + ", ".join(cast_sql(*b.expr(e, Scope([])), c.type) for e, c in zip(r, targets, strict=True)) + ")")
            df = self.spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t({', '.join(f'v{k}' for k in range(len(targets)))})")
        given = {c.name: f"v{k}" for k, c in enumerate(targets)}
        return df.selectExpr(*(f"{self._value(t, c, given)} AS {quote(c.name)}" for c in t.columns))

    @staticmethod
    def _value(t: TableDef, c: ColumnDef, given: dict[str, str]) -> str:
        return given.get(c.name) or c.default or f"CAST(NULL AS {SQL_NAME[c.type]})"

    def _matching(self, txn: Transaction, t: TableDef, where: A.Expr | None) -> DataFrame:
        return self._query(txn, A.Select((A.Item(None),), (A.Source(t.name, None, None),), where))[0]

    def _updated(self, txn: Transaction, t: TableDef, s: A.Update) -> DataFrame:
        """New rows, and old keys as __old0, __old1 and so on."""
        names = [n for n, _ in s.values]
        if len(set(names)) < len(names):
            raise ValueFault("a column is set twice")
        for n in names:
            t.column(n)
        with self._binder(txn) as b:
            view, cols = b.resolve(t.name)
            scope = Scope([(t.name, cols)])
            new = {n: cast_sql(*b.expr(e, scope), t.column(n).type) for n, e in s.values}
            items = [f"{new.get(c.name, quote(c.name))} AS {quote(c.name)}" for c in t.columns] + [f"{quote(k)} AS __old{i}" for i, k in enumerate(t.key)]
            text = f"SELECT {', '.join(items)} FROM {quote(view)} AS {quote(t.name)}"
            if s.where:
                cond, kind = b.expr(s.where, scope)
                b.need(kind, (Type.BOOLEAN,), "WHERE")
                text += f" WHERE {cond}"
            return self.spark.sql(text)

