"""Statements on stores: the reference scripts' subjects, transactions, constraints and the semantics ledger."""

import datetime

import pytest
from pyspark.errors import ArithmeticException

from tessera import operators as O
from tessera.display import render
from tessera.errors import AlreadyExistsError, ParseError, ReadOnlyError, SerializationError, TesseraError, UnimplementedError, ValueFault
from tessera.repl import command
from tessera.session import Session
from tessera.slt.script import Runner, parse
from tessera.sources import tpcc
from tessera.sources.store import Store
from tessera.txn import Transaction, TxnState
from tessera.types import Type, show


@pytest.fixture
def s(spark, tmp_path):
    return Session(spark, str(tmp_path / "store"))


def rows(s, sql):
    return sorted((tuple(r) for r in s.execute(sql).collect()), key=str)


@pytest.fixture
def t(s):
    s.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, x TEXT, n INTEGER, f DOUBLE, b BOOLEAN)")
    s.execute("INSERT INTO t (id, x, n, f, b) VALUES (1, 'a', 10, 1.5, TRUE), (2, NULL, NULL, NULL, NULL), (3, 'c', 0, -2, FALSE)")
    return s


WHERE = [
    ("n = NULL", []), ("x IS NULL", [2]), ("x IS NOT NULL", [1, 3]), ("NOT n = 10", [3]), ("b IS TRUE", [1]), ("b IS NOT TRUE", [2, 3]), ("b IS FALSE", [3]), ("b IS NOT FALSE", [1, 2]),
    ("n IN (0, NULL)", [3]), ("n NOT IN (0, NULL)", []), ("n NOT IN (0)", [1]), ("x LIKE '_' AND NOT x LIKE 'a%'", [3]), ("x ILIKE 'A'", [1]), ("n = 10.0", [1]), ("f < 0", [3]), ("b OR n IS NULL", [1, 2]),
    ("EXISTS (SELECT u.id FROM t AS u WHERE u.n > t.n)", [3]), ("NOT EXISTS (SELECT u.id FROM t AS u WHERE u.n > t.n)", [1, 2]), ("id IN (SELECT n / 5 + 1 FROM t)", [1, 3]), ("id NOT IN (SELECT n FROM t)", []),
    ("n > (SELECT count(*) FROM t)", [1]), ("n = (SELECT count(*) FROM t AS u WHERE u.id > 100)", [3]),
]


@pytest.mark.parametrize(("cond", "ids"), WHERE)
def test_where(t, cond, ids):
    assert rows(t, f"SELECT id FROM t WHERE {cond}") == [(i,) for i in ids]


def test_expressions(t):
    got = rows(t, "SELECT 7 / 2, -7 / 2, 7 / 2.0, -7 % 4, n / 3, f * 2, n + f, -n, upper(x) AS u, (1 + 2) * 3 FROM t WHERE id = 1")
    assert got == [(3, -3, 3.5, -3, 3, 3.0, 11.5, -10, "A", 9)]
    assert t.execute("SELECT 1 + 1, upper(x), count(*) FROM t GROUP BY x").columns == ["1 + 1", "upper(x)", "count(*)"]
    assert rows(t, "SELECT upper(x) AS u FROM t WHERE id = 2") == [(None,)]


@pytest.mark.parametrize("sql", ["SELECT x + 1 FROM t", "SELECT nope FROM t", "SELECT id FROM t WHERE x", "SELECT id FROM t WHERE x = 1", "SELECT upper(1) FROM t", "SELECT nofn(1) FROM t", "SELECT id FROM nope", "SELECT u.id FROM t AS u JOIN t AS v ON id = 1"])
def test_faults(t, sql):
    with pytest.raises(ValueFault):
        t.execute(sql)


def test_division_by_zero(t):
    with pytest.raises(ArithmeticException):
        t.execute("SELECT 1 / 0 FROM t").collect()


def test_aggregates(t):
    assert rows(t, "SELECT count(*) AS a, count(n) AS b, count(*) + 1 AS c FROM t") == [(3, 2, 4)]
    assert rows(t, "SELECT count(*) AS a FROM t WHERE id > 9") == [(0,)]
    assert rows(t, "SELECT n % 10 AS k, count(*) AS c FROM t GROUP BY n % 10 HAVING count(*) > 1") == [(0, 2)]
    assert rows(t, "SELECT x FROM t GROUP BY x") == [("a",), ("c",), (None,)]


def test_order_and_limits(t):
    got = [r.id for r in t.execute("SELECT id FROM t ORDER BY x").collect()]
    assert got == [2, 1, 3] and [r.id for r in t.execute("SELECT id, x FROM t ORDER BY x DESC").collect()] == [3, 1, 2]
    for text in ("OFFSET 1 LIMIT 1", "LIMIT 1 OFFSET 1", "LIMIT 1, 1"):
        assert [r.id for r in t.execute(f"SELECT id FROM t ORDER BY id {text}").collect()] == [2]


def test_joins(t):
    t.execute("CREATE TABLE u (k INTEGER PRIMARY KEY, n INTEGER)")
    t.execute("INSERT INTO u (k, n) VALUES (1, 10), (2, NULL), (4, 7)")
    assert rows(t, "SELECT t.id, u.k FROM t JOIN u ON t.n = u.n") == [(1, 1)]
    assert rows(t, "SELECT t.id, u.k FROM t LEFT JOIN u ON t.n = u.n") == [(1, 1), (2, None), (3, None)]
    assert rows(t, "SELECT t.id, u.k FROM t RIGHT JOIN u ON t.id = u.k AND t.n = u.n") == [(1, 1), (None, 2), (None, 4)]
    assert rows(t, "SELECT t.id, u.k FROM t FULL OUTER JOIN u ON t.id = u.k") == [(1, 1), (2, 2), (3, None), (None, 4)]
    assert rows(t, "SELECT t.id, u.k FROM t JOIN u ON t.id > u.k") == [(2, 1), (3, 1), (3, 2)]
    assert rows(t, "SELECT a.x FROM (SELECT id AS x FROM t) AS a WHERE a.x > 2") == [(3,)]


def test_constraints(s):
    s.execute("CREATE TABLE c (a INTEGER, b TEXT, u TEXT UNIQUE, d TIMESTAMP DEFAULT '2025-01-02 03:04:05', e DOUBLE DEFAULT 1, PRIMARY KEY (a, b))")
    s.execute("INSERT INTO c (a, b, u) VALUES (1, 'x', 'p'), (1, 'y', NULL), (2, 'x', NULL)")
    assert rows(s, "SELECT d, e FROM c WHERE b = 'y'") == [(datetime.datetime(2025, 1, 2, 3, 4, 5), 1.0)]
    for values, kind in (("(1, 'x', 'q')", AlreadyExistsError), ("(3, 'z', 'p')", AlreadyExistsError), ("(NULL, 'z', 'q')", ValueFault), ("(5, 'a', 'n'), (5, 'a', 'm')", AlreadyExistsError), ("(6, 'a', 'n'), (7, 'a', 'n')", AlreadyExistsError)):
        with pytest.raises(kind):
            s.execute(f"INSERT INTO c (a, b, u) VALUES {values}")
    with pytest.raises(AlreadyExistsError):
        s.execute("UPDATE c SET b = 'x' WHERE a = 1")
    assert rows(s, "SELECT count(*) AS n FROM c") == [(3,)]
    for bad in ("CREATE TABLE k (a INTEGER)", "CREATE TABLE k (a INTEGER PRIMARY KEY, a TEXT)", "CREATE TABLE k (a INTEGER PRIMARY KEY, b INTEGER DEFAULT 'x')", "CREATE TABLE k (a INTEGER PRIMARY KEY NULL)"):
        with pytest.raises(ValueFault):
            s.execute(bad)


def test_casts_on_write(t):
    t.execute("INSERT INTO t (id, x, f, b) VALUES (10, 2.5, 7, 3), (11, 2.0, 1, ''), (12, 5, TRUE, 'no')")
    assert rows(t, "SELECT id, x, f, b FROM t WHERE id >= 10") == [(10, "2.5", 7.0, True), (11, "2", 1.0, False), (12, "5", 1.0, True)]
    with pytest.raises(ValueFault):
        t.execute("INSERT INTO t (id) VALUES (1.5)")


def test_update_and_delete(t):
    assert rows(t, "UPDATE t SET n = n + 1, id = id + 1") == [(3,)]  # keys move over one another
    assert rows(t, "SELECT id, n FROM t") == [(2, 11), (3, None), (4, 1)]
    with pytest.raises(AlreadyExistsError):
        t.execute("UPDATE t SET id = id + 1 WHERE id < 4")  # onto a key that stays
    assert rows(t, "DELETE FROM t WHERE n IS NULL") == [(1,)] and rows(t, "SELECT id FROM t") == [(2,), (4,)]


def test_update_moves_keys(t):
    t.execute("UPDATE t SET id = id + 10")
    assert rows(t, "SELECT id, x FROM t") == [(11, "a"), (12, None), (13, "c")]
    t.execute("INSERT INTO t (id) VALUES (1)")
    t.execute("DELETE FROM t WHERE id > 11")
    assert rows(t, "SELECT id FROM t") == [(1,), (11,)]


def test_ddl(t):
    with pytest.raises(AlreadyExistsError):
        t.execute("CREATE TABLE t (a INTEGER PRIMARY KEY)")
    t.execute("CREATE TABLE IF NOT EXISTS t (a INTEGER PRIMARY KEY)")
    t.execute("CREATE INDEX i ON t (n)")
    with pytest.raises(AlreadyExistsError):
        t.execute("CREATE INDEX i ON t (x)")
    text = rows(t, "SHOW CREATE TABLE t")[0][0]
    assert "id INTEGER PRIMARY KEY NOT NULL" in text and "CREATE INDEX i ON t (n);" in text
    t.execute("DROP INDEX i ON t")
    with pytest.raises(ValueFault):
        t.execute("DROP INDEX i ON t")
    t.execute("INSERT INTO t (id, n) VALUES (4, 10)")
    with pytest.raises(AlreadyExistsError):
        t.execute("CREATE UNIQUE INDEX i ON t (n)")  # rows there already break it
    t.execute("ALTER TABLE t ADD COLUMN z INTEGER DEFAULT 5, DROP COLUMN x")
    assert rows(t, "SELECT id, z FROM t WHERE id < 3") == [(1, 5), (2, 5)] and "x" not in t.table("t").columns
    t.execute("ALTER TABLE t ADD COLUMN x TEXT")
    assert rows(t, "SELECT x FROM t WHERE id = 1") == [(None,)]  # not the dropped column's values
    for bad in ("ALTER TABLE t DROP COLUMN id", "ALTER TABLE t ADD COLUMN n TEXT", "ALTER TABLE t ADD COLUMN q TEXT NOT NULL", "ALTER TABLE nope DROP COLUMN a", "DROP TABLE nope"):
        with pytest.raises(TesseraError):
            t.execute(bad)
    t.execute("DROP TABLE t")
    t.execute("DROP TABLE IF EXISTS t")
    assert rows(t, "SHOW TABLES") == []


def two(spark, tmp_path):
    a, b = Session(spark, str(tmp_path / "kv")), Session(spark, str(tmp_path / "kv"))
    a.execute_script("CREATE TABLE kv (k TEXT PRIMARY KEY, v INTEGER); INSERT INTO kv (k, v) VALUES ('x', 1), ('y', 1)")
    return a, b


def test_isolation(spark, tmp_path):
    a, b = two(spark, tmp_path)
    a.execute("BEGIN")
    b.execute("BEGIN")
    a.execute("UPDATE kv SET v = 2 WHERE k = 'x'")
    assert rows(a, "SELECT v FROM kv WHERE k = 'x'") == [(2,)] and rows(b, "SELECT v FROM kv WHERE k = 'x'") == [(1,)]  # no dirty read
    with pytest.raises(SerializationError):  # no lost update
        b.execute("UPDATE kv SET v = 3 WHERE k = 'x'")
    a.execute("COMMIT")
    assert rows(b, "SELECT v FROM kv WHERE k = 'x'") == [(1,)]  # no fuzzy read
    with pytest.raises(SerializationError):
        b.execute("DELETE FROM kv WHERE k = 'x'")
    b.execute("UPDATE kv SET v = 9 WHERE k = 'y'")
    b.execute("COMMIT")
    assert rows(a, "SELECT k, v FROM kv") == [("x", 2), ("y", 9)]


@pytest.mark.parametrize(("first", "second"), [
    ("INSERT INTO kv (k, v) VALUES ('new', 1)", "INSERT INTO kv (k, v) VALUES ('new', 2)"),
    ("UPDATE kv SET v = 5 WHERE k = 'x'", "UPDATE kv SET v = 6 WHERE k = 'x'"),
    ("UPDATE kv SET v = 5 WHERE k = 'x'", "DELETE FROM kv WHERE k = 'x'"),
    ("DELETE FROM kv WHERE k = 'x'", "UPDATE kv SET v = 6"),
    ("UPDATE kv SET k = 'moved' WHERE k = 'x'", "INSERT INTO kv (k, v) VALUES ('moved', 2)"),
])
def test_two_writers_at_the_same_moment(spark, tmp_path, monkeypatch, first, second):
    """The second transaction writes after the first has checked its rows and before they are taken in."""
    a, b = two(spark, tmp_path)
    _meanwhile(monkeypatch, a, b, second)
    a.execute("BEGIN")
    b.execute("BEGIN")
    with pytest.raises(SerializationError):
        a.execute(first)
    b.execute("COMMIT")
    a.execute("ROLLBACK")
    keys = [k for k, _ in rows(a, "SELECT k, v FROM kv")]
    assert len(keys) == len(set(keys))


def _meanwhile(monkeypatch, a, b, *statements):
    """Has b execute statements when a is about to take its checked rows in."""
    take, done = Transaction._adopt, []

    def adopt(self, *args):
        if self.store is a.store and not done:
            done.append(True)
            for sql in statements:
                b.execute(sql)
        return take(self, *args)

    monkeypatch.setattr(Transaction, "_adopt", adopt)


def test_other_keys_at_the_same_moment_are_no_conflict(spark, tmp_path, monkeypatch):
    a, b = two(spark, tmp_path)
    _meanwhile(monkeypatch, a, b, "INSERT INTO kv (k, v) VALUES ('b', 2)", "UPDATE kv SET v = 7 WHERE k = 'y'")
    a.execute("INSERT INTO kv (k, v) VALUES ('a', 1)")
    assert rows(b, "SELECT k, v FROM kv ORDER BY k") == [("a", 1), ("b", 2), ("x", 1), ("y", 7)]


@pytest.mark.parametrize("second", ["INSERT INTO u (id, name) VALUES (2, 'n')", "CREATE UNIQUE INDEX by_age ON u (age)"])
def test_unique_values_at_the_same_moment(spark, tmp_path, monkeypatch, second):
    a, b = two(spark, tmp_path)
    a.execute("CREATE TABLE u (id INTEGER PRIMARY KEY, name TEXT UNIQUE, age INTEGER)")
    _meanwhile(monkeypatch, a, b, second)
    with pytest.raises(SerializationError):
        a.execute("INSERT INTO u (id, name, age) VALUES (1, 'n', 1)")
    assert len(rows(a, "SELECT id FROM u")) == ("INSERT" in second)


def test_a_unique_index_waits_for_open_writers(spark, tmp_path):
    a, b = two(spark, tmp_path)
    a.execute("BEGIN")
    a.execute("INSERT INTO kv (k, v) VALUES ('z', 1)")
    b.execute("UPDATE kv SET v = 2 WHERE k = 'y'")
    with pytest.raises(SerializationError):
        b.execute("CREATE UNIQUE INDEX by_v ON kv (v)")
    a.execute("ROLLBACK")
    b.execute("CREATE UNIQUE INDEX by_v ON kv (v)")


def test_log_of_the_store(spark, tmp_path):
    """Entries hold what changed and now and then all; a store opened late has the same state; two writers of one entry
    don't both succeed, and drafts don't stay."""
    root = str(tmp_path / "log")
    a, b = Store(spark, root), Store(spark, root)
    for k in range(150):
        (a if k % 3 else b).change(lambda m, k=k: (m["writes"].append({"version": k}), m["meta"].update({str(k % 7): str(k)}), m["active"].append(k), k % 2 and m["active"].remove(k)))
    late = Store(spark, root).read()
    assert late == a.read() == b.read() and [w["version"] for w in late["writes"]] == list(range(150)) and late["active"] == list(range(0, 150, 2))
    files = {p.name: p.stat().st_size for p in (tmp_path / "log" / "_log").iterdir() if not p.name.endswith(".crc")}
    assert len(files) == 150 and sum(files.values()) < 60_000
    assert not a._publish(149, {"state": {}}) and Store(spark, root).read() == late
    a.change(lambda m: m["meta"].pop("3"))
    assert "3" not in b.read()["meta"]


def test_writers_in_threads(spark, tmp_path):
    """Sessions that insert the same keys at once: every key is there once."""
    from concurrent.futures import ThreadPoolExecutor

    sessions = [Session(spark, str(tmp_path / "kv")) for _ in range(4)]
    sessions[0].execute("CREATE TABLE kv (k INTEGER PRIMARY KEY, v INTEGER)")

    def fill(i):
        won = 0
        for k in range(3):
            try:
                sessions[i].execute(f"INSERT INTO kv (k, v) VALUES ({k}, {i})")
                won += 1
            except (SerializationError, AlreadyExistsError):
                pass
        return won

    with ThreadPoolExecutor(4) as pool:
        won = sum(pool.map(fill, range(4)))
    keys = [k for (k,) in rows(sessions[0], "SELECT k FROM kv")]
    assert len(keys) == len(set(keys)) == won


def test_write_skew_is_allowed(spark, tmp_path):
    a, b = two(spark, tmp_path)
    for s in (a, b):
        s.execute("BEGIN")
        assert rows(s, "SELECT count(*) AS n FROM kv WHERE v = 1") == [(2,)]
    a.execute("UPDATE kv SET v = 0 WHERE k = 'x'")
    b.execute("UPDATE kv SET v = 0 WHERE k = 'y'")
    a.execute("COMMIT")
    b.execute("COMMIT")
    assert rows(a, "SELECT count(*) AS n FROM kv WHERE v = 0") == [(2,)]


def test_rollback_and_ddl(spark, tmp_path):
    a, b = two(spark, tmp_path)
    a.execute_script("BEGIN; DELETE FROM kv; CREATE TABLE other (a INTEGER PRIMARY KEY); INSERT INTO other (a) VALUES (1)")
    assert rows(a, "SELECT count(*) AS n FROM kv") == [(0,)] and rows(b, "SHOW TABLES") == [("kv",)]
    with pytest.raises(SerializationError):
        b.execute("INSERT INTO kv (k, v) VALUES ('x', 5)") if rows(b, "DELETE FROM kv WHERE k = 'x'") else None
    a.execute("ROLLBACK")
    assert rows(b, "SELECT count(*) AS n FROM kv") == [(2,)] and rows(a, "SHOW TABLES") == [("kv",)]


def test_time_travel(spark, tmp_path):
    a, _ = two(spark, tmp_path)  # 1 and 2
    a.execute("UPDATE kv SET v = 3 WHERE k = 'x'")  # 3
    a.execute("ALTER TABLE kv ADD COLUMN w TEXT DEFAULT 'w'")  # 4
    a.execute("BEGIN READ ONLY AS OF 3")
    assert rows(a, "SELECT * FROM kv") == [("x", 1), ("y", 1)]
    with pytest.raises(ReadOnlyError):
        a.execute("DELETE FROM kv")
    a.execute("COMMIT")
    assert rows(a, "SELECT * FROM kv") == [("x", 3, "w"), ("y", 1, "w")]
    for bad in ("BEGIN READ ONLY AS OF 99", "BEGIN AS OF 2", "COMMIT", "ROLLBACK"):
        with pytest.raises(ValueFault):
            a.execute(bad)
    assert rows(a, "BEGIN")[0][1] is False
    with pytest.raises(ValueFault):
        a.execute("BEGIN")


def test_as_of_hides_what_was_under_way(spark, tmp_path):
    a, b = two(spark, tmp_path)  # 1 and 2
    a.execute_script("BEGIN; UPDATE kv SET v = 5 WHERE k = 'x'")  # 3, still open
    b.execute("UPDATE kv SET v = 6 WHERE k = 'y'")  # 4
    a.execute("COMMIT")
    b.execute("BEGIN READ ONLY AS OF 4")
    assert rows(b, "SELECT k, v FROM kv") == [("x", 1), ("y", 1)]


def test_resume(t):
    t.execute("BEGIN")
    t.execute("DELETE FROM t WHERE id = 1")
    state = t.txn.state
    other = t.manager.resume(TxnState(state.version, state.read_only, state.active))
    assert other.snapshot(other.table("t")).count() == 2
    t.execute("ROLLBACK")
    with pytest.raises(ValueFault):
        t.manager.resume(state)


def test_access_api(t):
    t.execute("CREATE INDEX by_n ON t (n)")
    txn = t.manager.begin(read_only=True)
    d = txn.table("t")
    assert [r.x for r in txn.get(d, (3,)).collect()] == ["c"] and not txn.get(d, (99,)).collect()
    assert [r.id for r in txn.index_get(d, "by_n", (None,)).collect()] == [2]
    assert {r.n: [x.id for x in r.rows] for r in txn.index_scan(d, "by_n").collect()} == {10: [1], None: [2], 0: [3]}
    rw = t.manager.begin()
    rw.set_meta("a", "b")
    rw.rollback()
    assert txn.get_meta("a") == "b"


def test_filters_reach_the_files(t):
    plan = dict(t.execute("EXPLAIN PHYSICAL VERBOSE SELECT x FROM t WHERE id = 1").collect())
    assert "EqualTo(c0,1)" in plan["physical plan"] and "ReadSchema: struct<c0:bigint,c1:string>" in plan["physical plan"] and "Schema: struct<x:string>" in plan["logical plan"]
    for sql in ("INSERT INTO t (id) VALUES (5)", "UPDATE t SET n = 1", "DELETE FROM t WHERE id = 1", "DROP TABLE t"):
        assert t.execute(f"EXPLAIN {sql}").count() == 1
    assert rows(t, "SELECT count(*) AS n FROM t") == [(3,)]


def test_functions(t):
    t.register_scalar("twice", lambda a: a * 2, [Type.INTEGER], Type.INTEGER)
    t.register_aggregate("top", lambda a: int(a.max()), [Type.INTEGER], Type.INTEGER)
    assert rows(t, "SELECT twice(id) AS a FROM t WHERE id = 3") == [(6,)] and rows(t, "SELECT top(id) AS a FROM t") == [(3,)]
    for bad in ("SELECT twice(x) FROM t", "SELECT twice(id, id) FROM t", "SELECT twice(*) FROM t"):
        with pytest.raises(ValueFault):
            t.execute(bad)
    with pytest.raises(AlreadyExistsError):
        t.register_scalar("upper", lambda a: a, [Type.STRING], Type.STRING)
    with pytest.raises(UnimplementedError):
        t.execute("SELECT (1, 2) AS x FROM t")


SCRIPTS = {
    "basic": """
# staff
statement ok
CREATE TABLE staff (no INTEGER PRIMARY KEY, who TEXT NOT NULL, team TEXT, pay DECIMAL(9,2) NOT NULL, since TIMESTAMP, active BOOLEAN DEFAULT TRUE)

statement ok
INSERT INTO staff (no, who, team, pay, since) VALUES (1, 'Ada', 'Tools', 70000.00, '2022-01-15 09:30:00'), (2, 'Ben', 'Sales', 50000, '2021-09-10 10:00:00')

statement ok
INSERT INTO staff (no, who, pay, active) VALUES (4, 'Dora', 60000.00, TRUE)

query rowsort
SELECT no, pay + 5000 FROM staff WHERE team = 'Tools'
----
1 75000.00

query
SELECT who, since FROM staff WHERE no = 1
----
'Ada' '2022-01-15 09:30:00'

query rowsort
SELECT team, COUNT(*) AS n FROM staff GROUP BY team
----
NULL 1
'Tools' 1
'Sales' 1

statement error
INSERT INTO staff (no, who, pay) VALUES (1, 'Again', 1)

statement error
INSERT INTO staff (no, who, pay) VALUES (9, NULL, 1)

halt

statement ok
NOT REACHED
""",
    "join": """
statement ok
CREATE TABLE teams (team INTEGER PRIMARY KEY, title TEXT NOT NULL)

statement ok
CREATE TABLE staff (no INTEGER PRIMARY KEY, who TEXT NOT NULL, team INTEGER)

statement ok
INSERT INTO teams (team, title) VALUES (1, 'Tools'), (2, 'HR'), (3, 'Sales')

statement ok
INSERT INTO staff (no, who, team) VALUES (101, 'Ada', 1), (102, 'Ben', 1), (103, 'Cleo', 2), (104, 'Dan', NULL)

sleep 1ms

query rowsort
SELECT e.no, d.title FROM staff AS e JOIN teams AS d ON e.team = d.team
----
101 'Tools'
102 'Tools'
103 'HR'
""",
}


@pytest.mark.parametrize("name", SCRIPTS)
def test_scripts(spark, tmp_path, name):
    (tmp_path / "a.slt").write_text(SCRIPTS[name])
    (tmp_path / "b.slt").write_text("include a.slt\n")
    report = Runner(lambda: Session(spark, str(tmp_path / "s"))).run(tmp_path / "b.slt")
    assert report.passed, report.tap()
    assert report.tap().startswith(f"1..{len(report.results)}\nok 1 - line ")


def test_failing_script(spark, tmp_path):
    text = "statement ok\nCREATE TABLE q (a INTEGER PRIMARY KEY)\n\nquery\nSELECT count(*) AS n FROM q\n----\n1\n\nstatement error\nSELECT a FROM q\n"
    report = Runner(lambda: Session(spark, str(tmp_path / "s"))).run_text(text)
    assert [bool(why) for _, _, why in report.results] == [False, True, True] and "not ok 2" in report.tap()


@pytest.mark.parametrize("text", ["query\nSELECT 1", "nonsense", "sleep", "include x"])
def test_bad_scripts(text):
    with pytest.raises(ParseError):
        parse(text)


def test_tpcc(spark):
    want = {"warehouse": 10, "district": 100, "customer": 10_000, "history": 10_000, "new_order": 3000, "order": 10_000, "item": 10_000, "stock": 100_000}
    for t, n in want.items():
        df = tpcc.generate(spark, t)
        assert df.count() == n
    a, b = tpcc.generate(spark, "order"), tpcc.generate(spark, "order_line")
    assert a.agg({"o_ol_cnt": "sum"}).first()[0] == b.count() and a.where("o_carrier_id IS NULL").count() == 3000
    assert tpcc.generate(spark, "item").exceptAll(tpcc.generate(spark, "item")).count() == 0


def test_repl(t):
    assert "\\q" in command(t, "\\help") and command(t, "\\q") is None and "'t'" in command(t, "\\d") and "CREATE TABLE t" in command(t, "\\d t")


def test_display():
    assert render(["a"], [(None,), ("x\ny",), (1.0,), (True,)]).splitlines()[3:] == ["| NULL |", "| 'x   |", "| y'   |", "| 1.00 |", "| TRUE |", "+------+"]
    assert show(datetime.datetime(2025, 1, 2, 3, 4, 5)) == "'2025-01-02 03:04:05'"


def test_operators(spark):
    df = O.values(spark, [("k", Type.INTEGER), ("x", Type.STRING)], [(1, "a"), (2, None), (None, "b")])
    other = O.values(spark, [("k2", Type.INTEGER)], [(1,), (None,)])
    assert O.not_in(df, "k", other).count() == 0 and O.not_in(df, "k", other.where("k2 = 1")).count() == 1 and O.not_in(df, "k", other.where("false")).count() == 3
    on = df.k == other.k2
    assert O.exists(df, other, on).count() == 1 and O.not_exists(df, other, on).count() == 2
    assert [r.d for r in df.select(O.div(df, "k", "2").alias("d")).collect()] == [0, 1, None]
    assert [r.d for r in df.select(O.div(df, "k", "2.0D").alias("d")).collect()] == [0.5, 1.0, None]
    assert O.aggregate(df, ["x"]).count() == 3 and O.point_read(df, {"k": 2}).count() == 1 and O.limit(O.sort(df, ("k", False)), 1, 1).first().k == 1
