"""The TPC-C dataset, generated where it is stored.

Every row follows from its number and a seed by hash functions, so tables come from ranges, in parallel and alike each
time. Sizes: 10 warehouses with 10 districts each; 100 customers, and 100 orders of 5 to 15 lines, for a district; the
last 30 of a district's orders are new; 10000 items, stocked in every warehouse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: table: (prefix of its columns, runs of columns of one type, key)
TABLES = {
    "warehouse": ("w", "i id; s name street_1 street_2 city state zip; f tax ytd", "id"),
    "district": ("d", "i id w_id; s name street_1 street_2 city state zip; f tax ytd; i next_o_id", "w_id id"),
    "customer": ("c", "i id d_id w_id; s first middle last street_1 street_2 city state zip phone; t since; s credit; f credit_lim discount balance ytd_payment; i payment_cnt delivery_cnt; s data", "w_id d_id id"),
    "history": ("h", "i c_id c_d_id c_w_id d_id w_id; t date; f amount; s data", "c_id c_d_id c_w_id d_id w_id"),
    "new_order": ("no", "i o_id d_id w_id", "w_id d_id o_id"),
    "order": ("o", "i id d_id w_id c_id; t entry_d; i carrier_id ol_cnt; s all_local", "w_id d_id id"),
    "order_line": ("ol", "i o_id d_id w_id number i_id supply_w_id; t delivery_d; i quantity; f amount; s dist_info", "o_id d_id w_id number"),
    "item": ("i", "i id im_id; s name; f price; s data", "id"),
    "stock": ("s", "i i_id w_id quantity; s dist_01 dist_02 dist_03 dist_04 dist_05 dist_06 dist_07 dist_08 dist_09 dist_10; i ytd order_cnt remote_cnt; s data", "w_id i_id"),
}
KINDS = {"i": "INTEGER", "f": "DOUBLE", "s": "TEXT", "t": "TIMESTAMP"}


def ddl(table: str) -> str:
    """The statement that makes a table."""
    prefix, runs, key = TABLES[table]
    columns = [f"{prefix}_{name} {KINDS[run.split()[0]]}" for run in runs.split("; ") for name in run.split()[1:]]
    return f'CREATE TABLE "{table}" ({", ".join(columns)}, PRIMARY KEY ({", ".join(f"{prefix}_{k}" for k in key.split())}))'


DISTRICTS, CUSTOMERS, ORDERS, ITEMS, NEW = 10, 100, 100, 10_000, 30
SYLLABLES = ("BAR", "OUGHT", "ABLE", "PRI", "PRES", "ESE", "ANTI", "CALLY", "ATION", "EING")
NOW = "2025-01-01 00:00:00"


class _Rows:
    """Numbered rows and what hashes make of them."""

    def __init__(self, spark: SparkSession, n: int, seed: int):
        self.df, self.seed, self.salt = spark.range(n), seed, 0

    def hash(self) -> Column:
        self.salt += 1
        return F.xxhash64(F.col("id"), F.lit(self.seed), F.lit(self.salt))

    def whole(self, lo: int, hi: int) -> Column:
        return F.pmod(self.hash(), F.lit(hi - lo + 1)) + F.lit(lo)

    def part(self, lo: float, hi: float, digits: int) -> Column:
        scale = 10**digits
        return self.whole(round(lo * scale), round(hi * scale)) / F.lit(float(scale))

    def text(self, lo: int, hi: int) -> Column:
        body = F.concat(*(F.lower(F.hex(self.hash())) for _ in range(-(-hi // 16))))
        return F.substr(body, F.lit(1), self.whole(lo, hi).cast("int"))

    def digits(self, n: int) -> Column:
        return F.lpad(self.whole(0, 10**n - 1).cast("string"), n, "0")

    def state(self) -> Column:
        return F.concat(*(F.char(self.whole(65, 90)) for _ in range(2)))

    def place(self) -> dict[str, Column]:
        return {"street_1": self.text(10, 20), "street_2": self.text(10, 20), "city": self.text(10, 20), "state": self.state(), "zip": F.concat(self.digits(4), F.lit("11111"))}

    def marked(self, lo: int, hi: int) -> Column:
        """Text of which a tenth holds the word original."""
        return F.when(self.whole(0, 9) == 0, F.concat(self.text(1, lo), F.lit("original"), self.text(1, lo))).otherwise(self.text(lo, hi))


def _nth(per: int) -> Column:
    return F.col("id") % per + 1


def _group(per: int) -> Column:
    return F.floor(F.col("id") / per)


def _time() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def generate(spark: SparkSession, table: str, warehouses: int = 10, seed: int = 42) -> DataFrame:
    """The rows of one table."""
    if table == "warehouse":
        r = _Rows(spark, warehouses, seed)
        cols = {"w_id": F.col("id") + 1, "w_name": r.text(6, 10)} | {f"w_{k}": v for k, v in r.place().items()} | {"w_tax": r.part(0, 0.2, 4), "w_ytd": F.lit(300000.0)}
    elif table == "district":
        r = _Rows(spark, warehouses * DISTRICTS, seed + 1)
        cols = {"d_id": _nth(DISTRICTS), "d_w_id": _group(DISTRICTS) + 1, "d_name": r.text(6, 10)} | {f"d_{k}": v for k, v in r.place().items()}
        cols |= {"d_tax": r.part(0, 0.2, 4), "d_ytd": F.lit(30000.0), "d_next_o_id": F.lit(ORDERS + 1)}
    elif table in ("customer", "history"):
        r = _Rows(spark, warehouses * DISTRICTS * CUSTOMERS, seed + 2)
        c, d, w = _nth(CUSTOMERS), _group(CUSTOMERS) % DISTRICTS + 1, _group(CUSTOMERS * DISTRICTS) + 1
        if table == "history":
            cols = {"h_c_id": c, "h_c_d_id": d, "h_c_w_id": w, "h_d_id": d, "h_w_id": w, "h_date": _time(), "h_amount": F.lit(10.0), "h_data": r.text(12, 24)}
        else:
            names, n = F.array(*map(F.lit, SYLLABLES)), c - 1
            last = F.concat(*(F.element_at(names, (F.floor(n / k) % 10 + 1).cast("int")) for k in (100, 10, 1)))
            cols = {"c_id": c, "c_d_id": d, "c_w_id": w, "c_first": r.text(8, 16), "c_middle": F.lit("OE"), "c_last": last} | {f"c_{k}": v for k, v in r.place().items()}
            cols |= {"c_phone": r.digits(16), "c_since": _time(), "c_credit": F.when(r.whole(0, 9) == 0, "BC").otherwise("GC"), "c_credit_lim": F.lit(50000.0), "c_discount": r.part(0, 0.5, 4)}
            cols |= {"c_balance": F.lit(-10.0), "c_ytd_payment": F.lit(10.0), "c_payment_cnt": F.lit(1), "c_delivery_cnt": F.lit(0), "c_data": r.text(300, 500)}
    elif table in ("order", "order_line"):
        r = _Rows(spark, warehouses * DISTRICTS * ORDERS, seed + 3)
        o, d, w = _nth(ORDERS), _group(ORDERS) % DISTRICTS + 1, _group(ORDERS * DISTRICTS) + 1
        new, customer, carrier, lines = o > ORDERS - NEW, r.whole(1, CUSTOMERS), r.whole(1, 10), r.whole(5, 15)
        if table == "order":
            cols = {"o_id": o, "o_d_id": d, "o_w_id": w, "o_c_id": customer, "o_entry_d": _time(), "o_carrier_id": F.when(~new, carrier), "o_ol_cnt": lines, "o_all_local": F.lit("1")}
        else:
            heads = r.df.select(o.alias("o"), d.alias("d"), w.alias("w"), new.alias("new"), F.explode(F.sequence(F.lit(1), lines.cast("int"))).alias("n"))
            r = _Rows(spark, 0, seed + 4)
            r.df = heads.withColumn("id", F.xxhash64("o", "d", "w", "n"))
            cols = {"ol_o_id": F.col("o"), "ol_d_id": F.col("d"), "ol_w_id": F.col("w"), "ol_number": F.col("n"), "ol_i_id": r.whole(1, ITEMS), "ol_supply_w_id": F.col("w")}
            cols |= {"ol_delivery_d": F.when(~F.col("new"), _time()), "ol_quantity": F.lit(5), "ol_amount": F.when(F.col("new"), r.part(0.01, 9999.99, 2)).otherwise(0.0), "ol_dist_info": r.text(24, 24)}
    elif table == "new_order":
        r = _Rows(spark, warehouses * DISTRICTS * NEW, seed)
        cols = {"no_o_id": _nth(NEW) + ORDERS - NEW, "no_d_id": _group(NEW) % DISTRICTS + 1, "no_w_id": _group(NEW * DISTRICTS) + 1}
    elif table == "item":
        r = _Rows(spark, ITEMS, seed + 5)
        cols = {"i_id": F.col("id") + 1, "i_im_id": r.whole(1, 10_000), "i_name": r.text(14, 24), "i_price": r.part(1, 100, 2), "i_data": r.marked(26, 50)}
    elif table == "stock":
        r = _Rows(spark, warehouses * ITEMS, seed + 6)
        cols = {"s_i_id": _nth(ITEMS), "s_w_id": _group(ITEMS) + 1, "s_quantity": r.whole(10, 100)} | {f"s_dist_{k:02d}": r.text(24, 24) for k in range(1, 11)}
        cols |= {"s_ytd": F.lit(0), "s_order_cnt": F.lit(0), "s_remote_cnt": F.lit(0), "s_data": r.marked(26, 50)}
    else:
        raise ValueError(f"no table {table}")
    return r.df.select(*(v.alias(k) for k, v in cols.items()))


def export_csv(spark: SparkSession, folder: str, warehouses: int = 10, seed: int = 42) -> None:
    """A folder of CSV files for each table."""
    for t in TABLES:
        generate(spark, t, warehouses, seed).write.mode("overwrite").option("header", True).csv(f"{folder}/{t}")
