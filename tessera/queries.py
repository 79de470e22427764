"""The engine's operators as named queries over the test tables, and the same in DuckDB's SQL.

Most are statements of the engine's own SQL, run by a Session to which the tables are attached; the rest call the
operators or the transaction API directly.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import operators as O
from .errors import SerializationError, TesseraError
from .session import Session
from .slt.script import Runner
from .sources import tpcc
from .sources.folder import new_folder
from .types import Type

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
#: key -> the engine's SQL, or (the engine's SQL, DuckDB's).
SQL: dict[str, str | tuple[str, str]] = {
    "flagship": """SELECT n.n_name AS nation, COUNT(*) AS cnt FROM orders AS o JOIN customer AS c ON o.o_custkey = c.c_custkey JOIN nation AS n ON c.c_nationkey = n.n_nationkey
                   WHERE o.o_totalprice > 50000 AND c.c_acctbal > 0 GROUP BY n.n_name ORDER BY cnt DESC, nation LIMIT 10""",
    "scan_region": "SELECT * FROM region",
    "scan_filter": "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_discount < 0.03",
    "point_lookup": "SELECT * FROM customer WHERE c_custkey = 42",
    "derived_table": "SELECT a.k AS k FROM (SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 100000) AS a WHERE a.k > 100",
    "project_arith": "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, -l_quantity AS minus, +l_tax AS plus FROM lineitem",
    "project_constant": "SELECT r_regionkey, 1 + 1 AS two, 'x' AS x, NULL AS nothing FROM region",
    "int_divide": ("SELECT p_partkey, p_size / 7 AS whole, -p_size / 7 AS minus, p_retailprice / 7 AS part FROM part", "SELECT p_partkey, (p_size // 7)::BIGINT AS whole, (-p_size // 7)::BIGINT AS minus, p_retailprice / 7 AS part FROM part"),
    "modulo": "SELECT o_orderkey, o_orderkey % 7 AS m, (0 - o_orderkey) % 7 AS n FROM orders",
    "qualified_wildcard": "SELECT n.* FROM nation AS n JOIN region AS r ON n.n_regionkey = r.r_regionkey WHERE r.r_regionkey < 3",
    "filter_compare": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 10 AND l_quantity <= 40 AND l_discount > 0.01 AND l_tax < 0.07 AND l_returnflag != 'R' AND l_linestatus = 'O'",
    "filter_and_or_not": "SELECT o_orderkey FROM orders WHERE NOT o_orderstatus = 'F' AND (o_totalprice > 100000 OR o_orderpriority = '1-URGENT')",
    "is_true_family": "SELECT c_custkey, (c_acctbal > 0) IS TRUE AS t, (c_acctbal > 0) IS FALSE AS f, (c_acctbal > 0) IS NOT TRUE AS nt, (c_acctbal > 0) IS NOT FALSE AS nf, NULL IS NOT TRUE AS n FROM customer",
    "is_null": "SELECT c.c_custkey AS k, o.o_orderkey IS NULL AS absent, o.o_orderkey IS NOT NULL AS there FROM customer AS c LEFT JOIN orders AS o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000",
    "like": "SELECT p_partkey FROM part WHERE p_name LIKE '%wid_et'",
    "not_like": "SELECT p_partkey FROM part WHERE p_name NOT LIKE '%e%'",
    "ilike": "SELECT p_partkey FROM part WHERE p_name ILIKE '%BOLT' AND p_brand NOT ILIKE 'brand#1%'",
    "in_list": "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (1, 3, 5, 7)",
    "not_in_list": "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (1, 3, 5, 7)",
    "in_subquery": "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)",
    "not_in_subquery": "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)",
    "in_subquery_correlated": "SELECT c_custkey FROM customer AS c WHERE c.c_custkey IN (SELECT o.o_custkey FROM orders AS o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > c.c_acctbal * 20)",
    "exists": "SELECT c_custkey FROM customer AS c WHERE EXISTS (SELECT o.o_orderkey FROM orders AS o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)",
    "exists_uncorrelated": "SELECT r_regionkey FROM region WHERE EXISTS (SELECT o_orderkey FROM orders WHERE o_totalprice > 1000)",
    "not_exists": "SELECT c_custkey FROM customer AS c WHERE NOT EXISTS (SELECT o.o_orderkey FROM orders AS o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)",
    "scalar_subquery": "SELECT o_orderkey, (SELECT COUNT(*) FROM nation) AS nations FROM orders WHERE o_orderkey < (SELECT COUNT(*) FROM customer)",
    "scalar_subquery_correlated": "SELECT c.c_custkey AS k, (SELECT COUNT(*) FROM orders AS o WHERE o.o_custkey = c.c_custkey) AS cnt FROM customer AS c",
    "join_inner": "SELECT o.o_orderkey AS k, c.c_name AS name FROM orders AS o JOIN customer AS c ON o.o_custkey = c.c_custkey AND o.o_totalprice > c.c_acctbal * 10",
    "join_self": "SELECT a.n_name AS a, b.n_name AS b FROM nation AS a INNER JOIN nation AS b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_multiway": """SELECT n.n_name AS nation, l.l_returnflag AS flag, COUNT(*) AS cnt FROM lineitem AS l JOIN orders AS o ON l.l_orderkey = o.o_orderkey JOIN customer AS c ON o.o_custkey = c.c_custkey
                        JOIN nation AS n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name, l.l_returnflag""",
    "join_left": "SELECT c.c_custkey AS k, o.o_orderkey AS o FROM customer AS c LEFT JOIN orders AS o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 250000",
    "join_right": "SELECT c.c_custkey AS k, o.o_orderkey AS o FROM orders AS o RIGHT OUTER JOIN customer AS c ON c.c_custkey = o.o_custkey AND o.o_totalprice > 250000",
    "join_full": "SELECT s.s_suppkey AS s, c.c_custkey AS c FROM supplier AS s FULL JOIN customer AS c ON s.s_suppkey = c.c_custkey AND c.c_acctbal > 0",
    "join_multi_key": "SELECT a.l_orderkey AS k, COUNT(*) AS cnt FROM lineitem AS a JOIN lineitem AS b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber GROUP BY a.l_orderkey",
    "join_theta": "SELECT n.n_nationkey AS n, r.r_regionkey AS r FROM nation AS n JOIN region AS r ON n.n_regionkey < r.r_regionkey",
    "join_null_keys": "SELECT COUNT(*) AS cnt FROM (SELECT o.o_orderkey AS k FROM customer AS c LEFT JOIN orders AS o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000) AS a JOIN (SELECT o.o_orderkey AS k FROM customer AS c LEFT JOIN orders AS o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000) AS b ON a.k = b.k",
    "count_star": "SELECT COUNT(*) AS cnt FROM orders",
    "count_col": "SELECT COUNT(o.o_orderkey) AS cnt, COUNT(*) AS total FROM customer AS c LEFT JOIN orders AS o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000",
    "count_empty": "SELECT COUNT(*) AS cnt, COUNT(o_orderkey) AS keys FROM orders WHERE o_orderkey < 0",
    "group_minimum": "SELECT l_returnflag, l_linestatus, COUNT(*) AS cnt FROM lineitem WHERE l_quantity > 10 AND l_discount < 0.05 GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus",
    "group_multi": "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS a, COUNT(*) AS b FROM orders GROUP BY o_orderstatus, o_orderpriority",
    "group_null": "SELECT o.o_orderstatus AS s, COUNT(*) AS cnt FROM customer AS c LEFT JOIN orders AS o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000 GROUP BY o.o_orderstatus",
    "group_only": "SELECT o_orderpriority FROM orders GROUP BY o_orderpriority",
    "group_expr": "SELECT o_orderkey % 5 AS m, COUNT(*) AS cnt FROM orders GROUP BY o_orderkey % 5",
    "agg_expr": "SELECT o_orderstatus, COUNT(*) + 1 AS more, 2 * COUNT(*) AS twice, UPPER(o_orderstatus) AS up FROM orders GROUP BY o_orderstatus",
    "having": "SELECT o_custkey, COUNT(*) AS cnt FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12",
    "order_nulls": ("SELECT c.c_custkey AS k, o.o_orderkey AS o FROM customer AS c LEFT JOIN orders AS o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000 ORDER BY o, k DESC LIMIT 50",
                    "SELECT c.c_custkey AS k, o.o_orderkey AS o FROM customer AS c LEFT JOIN orders AS o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000 ORDER BY o NULLS FIRST, k DESC LIMIT 50"),
    "limit_offset": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey OFFSET 7 LIMIT 25", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 7"),
    "limit_pair": ("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5, 20", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5"),
    "limit_n_offset": "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 20 OFFSET 5",
    "top_k": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100",
    "upper": "SELECT c_custkey, UPPER(c_mktsegment) AS up FROM customer",
    "timestamp_compare": ("SELECT o_orderkey FROM orders WHERE o_orderdate > '1997-01-01 00:00:00'", "SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1997-01-01 00:00:00'"),
    "join_events": "SELECT e.event_type AS kind, COUNT(*) AS cnt FROM events AS e JOIN customer AS c ON e.user_id = c.c_custkey GROUP BY e.event_type",
}


def session(spark: SparkSession, sf_dir: str, *tables: str) -> Session:
    """A session on a new store, with the test tables attached."""
    s = Session(spark, new_folder(spark))
    for t in tables:
        s.attach(t, spark.read.parquet(f"{sf_dir}/{t}.parquet"))
    return s


def _statement(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    used = [t for t in TABLES if t in sql]
    return lambda spark, sf_dir: session(spark, sf_dir, *used).execute(sql)


# --- queries that are more than a statement


def values_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir)
    s.execute("CREATE TABLE v (i INTEGER PRIMARY KEY, f DOUBLE, t TEXT, b BOOLEAN, ts TIMESTAMP)")
    s.execute("INSERT INTO v (i, f, t, b, ts) VALUES (1, 1.5, 'a', TRUE, '2025-01-02 03:04:05'), (2, 2, NULL, FALSE, NULL), (3, NULL, '', NULL, '2000-01-01 00:00:00')")
    return s.execute("SELECT * FROM v")


def casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every allowed pair of the cast matrix, over columns."""
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("i"), F.col("o_totalprice").alias("f"), F.col("o_orderstatus").alias("s"), (F.col("o_orderkey") % 2 == 0).alias("b"))
    pairs = (("b", Type.INTEGER), ("b", Type.FLOAT), ("b", Type.STRING), ("i", Type.BOOLEAN), ("i", Type.FLOAT), ("i", Type.STRING), ("f", Type.BOOLEAN), ("s", Type.BOOLEAN))
    return df.select("i", *(O.cast_to(df, c, t).alias(f"{c}_{t.value}") for c, t in pairs))


def not_in_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NOT IN a set with a NULL is never true; shown by a count."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    sub = nation.select(F.nullif(F.col("n_nationkey"), F.lit(3)).alias("k"))
    return O.aggregate(O.not_in(nation, "n_regionkey", sub), [], F.count(F.lit(1)).alias("cnt"))


def operators_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator functions end to end, without SQL text."""
    o = O.scan(spark, f"{sf_dir}/orders.parquet", [F.col("o_totalprice") > 1000])
    c = O.scan(spark, f"{sf_dir}/customer.parquet")
    rows = O.join(o, c, F.col("o_custkey") == F.col("c_custkey"))
    rows = O.filter_rows(rows, O.is_true(F.col("c_acctbal") > 0) & O.like(F.col("c_mktsegment"), "%U%") & O.in_list(F.col("o_orderstatus"), ["F", "P"], negated=True))
    return O.limit(O.sort(O.aggregate(rows, ["c_mktsegment"], F.count(F.lit(1)).alias("cnt")), ("cnt", True), ("c_mktsegment", False)), 3)


def udf_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir, "part")

    def initials(a: pd.Series) -> pd.Series:
        return a.str[:3] + "."

    s.register_scalar("initials", initials, [Type.STRING], Type.STRING)
    return s.execute("SELECT p_partkey, initials(p_brand) AS short FROM part")


def udf_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir, "orders")

    def widest(a: pd.Series) -> float:
        return float(a.max() - a.min())

    s.register_aggregate("spread", widest, [Type.FLOAT], Type.FLOAT)
    return s.execute("SELECT o_orderpriority, spread(o_totalprice) AS wide FROM orders GROUP BY o_orderpriority")


NATION = "CREATE TABLE copy (id INTEGER PRIMARY KEY, name TEXT NOT NULL, region INTEGER, hits INTEGER DEFAULT 7)"
FILL = "INSERT INTO copy (id, name, region) SELECT n_nationkey, n_name, n_regionkey FROM nation"


def _copied(spark: SparkSession, sf_dir: str) -> Session:
    s = session(spark, sf_dir, "nation")
    s.execute_script(f"{NATION}; {FILL}")
    return s


def dml_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _copied(spark, sf_dir)
    s.execute("INSERT INTO copy (id, name) VALUES (100, 'new'), (101, 'newer')")
    return s.execute("SELECT * FROM copy")


def dml_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _copied(spark, sf_dir)
    s.execute("UPDATE copy SET hits = hits + region, id = id + 1000 WHERE region < 2")
    return s.execute("SELECT * FROM copy")


def dml_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _copied(spark, sf_dir)
    s.execute("DELETE FROM copy WHERE region = 1 OR name LIKE '%\\_2%'")
    return s.execute("SELECT * FROM copy")


def dml_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _copied(spark, sf_dir).execute("DELETE FROM copy WHERE region = 1")


def alter_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _copied(spark, sf_dir)
    s.execute("ALTER TABLE copy ADD COLUMN note TEXT DEFAULT 'none', DROP COLUMN hits")
    s.execute("INSERT INTO copy (id, name, note) VALUES (100, 'new', 'fresh')")
    return s.execute("SELECT * FROM copy")


def mvcc_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a transaction sees of one that began before it and ended after."""
    s = _copied(spark, sf_dir)
    other = Session(spark, s.store.root)
    other.execute("BEGIN")
    other.execute("UPDATE copy SET name = 'hidden' WHERE region = 0")
    s.execute("BEGIN READ ONLY")
    other.execute("COMMIT")
    return s.execute("SELECT id, name FROM copy")


def mvcc_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _copied(spark, sf_dir)  # versions 1 and 2
    s.execute("UPDATE copy SET hits = 0 WHERE region = 0")  # 3
    s.execute("DELETE FROM copy WHERE region = 1")  # 4
    s.execute("INSERT INTO copy (id, name) VALUES (500, 'late')")  # 5
    s.execute("BEGIN READ ONLY AS OF 4")
    return s.execute("SELECT id, hits FROM copy")


def mvcc_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _copied(spark, sf_dir)
    s.execute_script("BEGIN; DELETE FROM copy WHERE id < 10; ROLLBACK")
    return s.execute("SELECT COUNT(*) AS cnt FROM copy")


def index_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _copied(spark, sf_dir)
    s.execute("CREATE INDEX by_region ON copy (region)")
    txn = s.manager.begin(read_only=True)
    return txn.index_get(txn.table("copy"), "by_region", (2,)).select("id", "name")


def index_scan_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key of an index with its rows, NULL a key as well."""
    s = session(spark, sf_dir, "customer", "orders")
    s.execute("CREATE TABLE kept (id INTEGER PRIMARY KEY, segment TEXT)")
    s.execute("CREATE INDEX by_segment ON kept (segment)")
    s.execute("INSERT INTO kept (id, segment) SELECT c_custkey, c_mktsegment FROM customer")
    s.execute("UPDATE kept SET segment = NULL WHERE id % 10 = 0")
    txn = s.manager.begin(read_only=True)
    rows = txn.index_scan(txn.table("kept"), "by_segment")
    return rows.select("segment", F.size("rows").cast("long").alias("rows_of_key"), F.array_min("rows.id").alias("first_id"), F.aggregate("rows.id", F.lit(0).cast("long"), lambda a, x: a + x).alias("ids"))


def refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements that a rule forbids, with the error of each; and the rows, which they leave as they were."""
    s = _copied(spark, sf_dir)
    s.execute("CREATE UNIQUE INDEX by_name ON copy (name)")
    out = []
    for sql in (
        "INSERT INTO copy (id, name) SELECT n_nationkey, 'again' FROM nation", "INSERT INTO copy (id, name) VALUES (200, 'x'), (200, 'y')", "INSERT INTO copy (id, name) SELECT 300, n_name FROM nation WHERE n_nationkey = 3",
        "UPDATE copy SET name = 'same'", "UPDATE copy SET id = 1 WHERE id = 2", "INSERT INTO copy (id, name) VALUES (201, NULL)", "CREATE UNIQUE INDEX by_region ON copy (region)", "CREATE TABLE copy (id INTEGER PRIMARY KEY)",
    ):
        try:
            s.execute(sql).collect()
            out.append((len(out), "none"))
        except TesseraError as e:
            out.append((len(out), type(e).__name__))
    names = spark.createDataFrame(out, "k long, what string")
    return names.union(s.execute("SELECT id, name FROM copy"))


def mvcc_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two transactions at once that write the same keys: the first writer wins, whichever commits first; others go on."""
    s = _copied(spark, sf_dir)
    other = Session(spark, s.store.root)
    s.execute("BEGIN")
    other.execute("BEGIN")
    s.execute("UPDATE copy SET hits = 1 WHERE region = 0")
    s.execute("INSERT INTO copy (id, name) VALUES (700, 'mine')")
    out = []
    for sql in ("UPDATE copy SET hits = 2 WHERE region = 0", "DELETE FROM copy WHERE region = 0", "INSERT INTO copy (id, name) VALUES (700, 'theirs')", "UPDATE copy SET hits = 3 WHERE region = 1"):
        try:
            other.execute(sql).collect()
            out.append((-1 - len(out), "done", 0))
        except SerializationError:
            out.append((-1 - len(out), "refused", 0))
    other.execute("COMMIT")
    s.execute("COMMIT")
    return spark.createDataFrame(out, "id long, name string, hits long").union(s.execute("SELECT id, name, hits FROM copy"))


def drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DROP INDEX lets values repeat, DROP TABLE ends a table, and its name can be used again."""
    s = _copied(spark, sf_dir)
    s.execute("CREATE UNIQUE INDEX by_name ON copy (name)")
    s.execute("DROP INDEX by_name ON copy")
    s.execute("INSERT INTO copy (id, name) SELECT n_nationkey + 100, n_name FROM nation")
    before = s.execute("SELECT COUNT(*) AS cnt FROM copy").first().cnt
    s.execute("DROP TABLE copy")
    s.execute("CREATE TABLE copy (id INTEGER PRIMARY KEY)")
    s.execute("INSERT INTO copy (id) VALUES (1)")
    return s.execute(f"SELECT id, {before} AS before FROM copy")


def key_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    txn = _copied(spark, sf_dir).manager.begin(read_only=True)
    return txn.get(txn.table("copy"), (5,))


def show_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _copied(spark, sf_dir).execute("SHOW TABLES")


def show_create_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _copied(spark, sf_dir).execute("SHOW CREATE TABLE copy")


def explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of plan, and whether the filter and the columns reach the file."""
    plan = session(spark, sf_dir, "nation").execute("EXPLAIN PHYSICAL VERBOSE SELECT n_name FROM nation WHERE n_nationkey = 1")
    text = F.col("plan")
    return plan.select("type", text.contains("PushedFilters: [IsNotNull(n_nationkey), EqualTo(n_nationkey,1)]").alias("filter_in_scan"), (text.contains("ReadSchema") & ~text.rlike("ReadSchema: [^\n]*n_regionkey")).alias("columns_pruned"))


def check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session(spark, sf_dir).execute("CHECK SELECT a.x, count(*) AS n FROM t AS a WHERE NOT a.x = 1 GROUP BY a.x LIMIT 2, 3")


def dataset_tpcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generated dataset in versioned tables: the rows of each, and the orders whose lines aren't as many as they say."""
    s = session(spark, sf_dir)
    s.execute("CREATE DATASET tpcc")
    counts = [s.execute(f'SELECT COUNT(*) AS n FROM "{t}"').select(F.lit(t).alias("name"), "n") for t in tpcc.TABLES if t != "order_line"]
    lines = s.execute("""SELECT o.o_id AS o, o.o_d_id AS d, o.o_w_id AS w, o.o_ol_cnt AS said FROM "order" AS o JOIN order_line AS l ON o.o_w_id = l.ol_w_id AND o.o_d_id = l.ol_d_id AND o.o_id = l.ol_o_id
                         GROUP BY o.o_id, o.o_d_id, o.o_w_id, o.o_ol_cnt HAVING COUNT(*) = o.o_ol_cnt""")
    return reduce(DataFrame.union, [*counts, lines.agg(F.count(F.lit(1)).alias("n")).select(F.lit("orders with their lines").alias("name"), "n")])


def logic_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script run by the logic-test runner, as its report."""
    script = "statement ok\nCREATE TABLE t (id INTEGER PRIMARY KEY, x TEXT)\n\nstatement ok\nINSERT INTO t (id, x) VALUES (1, 'a'), (2, NULL)\n\nquery rowsort\nSELECT id, x FROM t\n----\n1 'a'\n2 NULL\n\nstatement error\nINSERT INTO t (id) VALUES (1)\n"
    report = Runner(lambda: session(spark, sf_dir)).run_text(script)
    return spark.createDataFrame([(line, not why) for line, _, why in report.results], "line int, ok boolean")


CODE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "values_rows": (values_rows, "SELECT * FROM (VALUES (1::BIGINT, 1.5::DOUBLE, 'a', TRUE, TIMESTAMP '2025-01-02 03:04:05'), (2, 2, NULL, FALSE, NULL), (3, NULL, '', NULL, TIMESTAMP '2000-01-01 00:00:00')) v(i, f, t, b, ts)"),
    "cast_matrix": (casts, """SELECT o_orderkey AS i, (o_orderkey % 2 = 0)::BIGINT AS b_integer, (o_orderkey % 2 = 0)::INT::DOUBLE AS b_float, (o_orderkey % 2 = 0)::VARCHAR AS b_string, o_orderkey <> 0 AS i_boolean,
        o_orderkey::DOUBLE AS i_float, o_orderkey::VARCHAR AS i_string, o_totalprice <> 0 AS f_boolean, length(o_orderstatus) > 0 AS s_boolean FROM orders"""),
    "not_in_null": (not_in_null, "SELECT count(*) AS cnt FROM nation WHERE n_regionkey NOT IN (SELECT nullif(n_nationkey, 3) FROM nation)"),
    "operators_chain": (operators_chain, """SELECT c_mktsegment, count(*) AS cnt FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000 AND c_acctbal > 0 AND c_mktsegment LIKE '%U%' AND o_orderstatus NOT IN ('F', 'P')
        GROUP BY c_mktsegment ORDER BY cnt DESC, c_mktsegment LIMIT 3"""),
    "udf_scalar": (udf_scalar, "SELECT p_partkey, left(p_brand, 3) || '.' AS short FROM part"),
    "udf_aggregate": (udf_aggregate, "SELECT o_orderpriority, max(o_totalprice) - min(o_totalprice) AS wide FROM orders GROUP BY o_orderpriority"),
    "dml_insert": (dml_insert, "SELECT n_nationkey::BIGINT AS id, n_name AS name, n_regionkey::BIGINT AS region, 7::BIGINT AS hits FROM nation UNION ALL VALUES (100, 'new', NULL, 7), (101, 'newer', NULL, 7)"),
    "dml_update": (dml_update, "SELECT CASE WHEN n_regionkey < 2 THEN n_nationkey + 1000 ELSE n_nationkey END::BIGINT AS id, n_name AS name, n_regionkey::BIGINT AS region, CASE WHEN n_regionkey < 2 THEN 7 + n_regionkey ELSE 7 END::BIGINT AS hits FROM nation"),
    "dml_delete": (dml_delete, "SELECT n_nationkey::BIGINT AS id, n_name AS name, n_regionkey::BIGINT AS region, 7::BIGINT AS hits FROM nation WHERE NOT (n_regionkey = 1 OR n_name LIKE '%\\_2%' ESCAPE '\\')"),
    "dml_count": (dml_count, "SELECT count(*) AS count FROM nation WHERE n_regionkey = 1"),
    "alter_table": (alter_table, "SELECT n_nationkey::BIGINT AS id, n_name AS name, n_regionkey::BIGINT AS region, 'none' AS note FROM nation UNION ALL VALUES (100, 'new', NULL, 'fresh')"),
    "mvcc_snapshot": (mvcc_snapshot, "SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation"),
    "mvcc_as_of": (mvcc_as_of, "SELECT n_nationkey::BIGINT AS id, CASE WHEN n_regionkey = 0 THEN 0 ELSE 7 END::BIGINT AS hits FROM nation"),
    "mvcc_rollback": (mvcc_rollback, "SELECT count(*) AS cnt FROM nation"),
    "index_read": (index_read, "SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation WHERE n_regionkey = 2"),
    "key_read": (key_read, "SELECT n_nationkey::BIGINT AS id, n_name AS name, n_regionkey::BIGINT AS region, 7::BIGINT AS hits FROM nation WHERE n_nationkey = 5"),
    "show_tables": (show_tables, "SELECT 'copy' AS tables"),
    "show_create_table": (show_create_table, "SELECT concat_ws(chr(10), 'CREATE TABLE copy (', '  id INTEGER PRIMARY KEY NOT NULL,', '  name TEXT NOT NULL,', '  region INTEGER,', '  hits INTEGER DEFAULT 7', ');') AS create_table_stmt"),
    "explain": (explain, "SELECT * FROM (VALUES ('logical plan', FALSE, FALSE), ('physical plan', TRUE, TRUE)) v(type, filter_in_scan, columns_pruned)"),
    "index_scan_grouped": (index_scan_grouped, "SELECT CASE WHEN c_custkey % 10 <> 0 THEN c_mktsegment END AS segment, count(*) AS rows_of_key, min(c_custkey)::BIGINT AS first_id, sum(c_custkey)::BIGINT AS ids FROM customer GROUP BY ALL"),
    "refused": (refused, """SELECT * FROM (VALUES (0::BIGINT, 'AlreadyExistsError'), (1, 'AlreadyExistsError'), (2, 'AlreadyExistsError'), (3, 'AlreadyExistsError'), (4, 'AlreadyExistsError'), (5, 'ValueFault'), (6, 'AlreadyExistsError'), (7, 'AlreadyExistsError')) v(k, what)
        UNION ALL SELECT n_nationkey::BIGINT, n_name FROM nation"""),
    "mvcc_conflict": (mvcc_conflict, """SELECT * FROM (VALUES (-1::BIGINT, 'refused', 0::BIGINT), (-2, 'refused', 0), (-3, 'refused', 0), (-4, 'done', 0), (700, 'mine', 7)) v(id, name, hits)
        UNION ALL SELECT n_nationkey::BIGINT, n_name, CASE n_regionkey WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 7 END::BIGINT FROM nation"""),
    "drops": (drops, "SELECT 1::BIGINT AS id, 2 * count(*) AS before FROM nation"),
    "check": (check, "SELECT 'SELECT a.x, count(*) AS n FROM t AS a WHERE NOT (a.x = 1) GROUP BY a.x OFFSET 2 LIMIT 3' AS parsed_sql"),
    "dataset_tpcc": (dataset_tpcc, """SELECT * FROM (VALUES ('warehouse', 10::BIGINT), ('district', 100), ('customer', 10000), ('history', 10000), ('order', 10000), ('new_order', 3000), ('item', 10000), ('stock', 100000),
        ('orders with their lines', 10000)) v(name, n)"""),
    "logic_test": (logic_test, "SELECT * FROM (VALUES (1, TRUE), (4, TRUE), (7, TRUE), (13, TRUE)) v(line, ok)"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _statement(v if isinstance(v, str) else v[0]) for k, v in SQL.items()} | {k: f for k, (f, _) in CODE.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v if isinstance(v, str) else v[1] for k, v in SQL.items()} | {k: sql for k, (_, sql) in CODE.items() if sql}
