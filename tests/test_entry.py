"""The driver's contract, with and without the corpus subpackage, and random predicates against DuckDB."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from tessera.session import Session

DATA = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 70


def test_without_the_corpus_subpackage(tmp_path):
    """A copy without it still imports and has the engine's queries."""
    top = Path(entry.__file__).parent
    for name in ("tessera", "__spark_entry__.py"):
        (shutil.copytree if (top / name).is_dir() else shutil.copy)(top / name, tmp_path / name)
    shutil.rmtree(tmp_path / "tessera" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 70 and set(o) <= set(q) and 'pipeline' not in q and not any(k[:2] == 'op' and k[2:3].isdigit() for k in q); print(e.__file__)"
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert got.returncode == 0 and str(tmp_path) in got.stdout, got.stderr


@pytest.mark.parametrize("name", ["flagship", "int_divide", "not_in_null", "dml_update", "mvcc_as_of", "order_nulls", "alter_table", "mvcc_conflict", "refused", "drops", "index_scan_grouped", "explain", "show_create_table", "limit_n_offset"])
def test_queries_match_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("nation", "customer", "orders", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = entry.queries()[name](spark, DATA)
    want = con.sql(entry.oracle_sql()[name])
    order = sorted(range(len(want.columns)), key=lambda k: want.columns[k])
    assert sorted(want.columns) == sorted(df.columns)
    assert sorted(str(tuple(r[k] for k in order)) for r in want.fetchall()) == sorted(str(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())


ATOMS = st.sampled_from(["a = 1", "a < b", "b IS NULL", "s LIKE '%x%'", "s IS NOT NULL", "(a > 0) IS TRUE", "(b > 0) IS NOT FALSE", "a IN (1, 2, NULL)", "b NOT IN (0, 3)", "a + b > 2", "a % 2 = 1", "s ILIKE 'X_'"])
PREDICATES = st.recursive(ATOMS, lambda x: st.one_of(st.tuples(x, st.sampled_from(["AND", "OR"]), x).map(lambda p: f"({p[0]} {p[1]} {p[2]})"), x.map(lambda p: f"(NOT {p})")), max_leaves=5)


@pytest.fixture(scope="module")
def engines(spark, tmp_path_factory):
    rows = [(k, a, b, s) for k, (a, b, s) in enumerate((a, b, s) for a in (None, 0, 1, 2) for b in (None, 0, 3) for s in (None, "x", "Xy", "z"))]
    con = duckdb.connect()
    con.sql("CREATE TABLE t (k BIGINT, a BIGINT, b BIGINT, s VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", rows)
    s = Session(spark, str(tmp_path_factory.mktemp("store")))
    s.attach("t", spark.createDataFrame(rows, "k long, a long, b long, s string"))
    return s, con


@given(PREDICATES)
@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_predicates_match_duckdb(engines, cond):
    s, con = engines
    assert sorted(r.k for r in s.execute(f"SELECT k FROM t WHERE {cond}").collect()) == sorted(k for (k,) in con.sql(f"SELECT k FROM t WHERE {cond}").fetchall())
