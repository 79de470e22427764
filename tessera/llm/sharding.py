"""A consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

The ring has a fixed number of cells. A shard stands at several cells, its virtual nodes; a document's text hashes to
a cell, and so copies start from one place. Documents go clockwise to the first virtual node whose shard has room: a
shard holds at most (1 + slack) times the mean. What a full shard can't take goes on clockwise, which keeps the
balance guaranteed and moves few documents when shards come or go. The walk needs only the bytes of each cell; the
driver sees one number a cell, whatever the size of the corpus, and the walk's outcome is a list of byte ranges of
cells. A document falls in the range that its middle byte lies in, so ranges are kept to within half a document.
Documents above 1 / 200 of a shard, of which there can't be more than 200 a shard, walk first, each by itself and
whole, so that rounding to documents stays below 1 / 400 of a shard.

The law is `bytes`: the shards' sizes are near equal. A cell may hold a third of all rows (one text copied, with or
without doc_ids): cells are split by row into parts of about 1000 rows for the running sums.

Defined cases. Null text has no bytes and so size 1. Equal texts stay together unless a shard fills up among them.
Rows that repeat a doc_id, or have none, are placed like any other. An empty table gives no rows. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, rows_table, save

CELL_BITS = 14
VNODES = 128
PART_ROWS = 1000
#: Documents above 1 / LARGE of a shard are placed one by one.
LARGE = 200


def ring(spark: SparkSession, shards: int, vnodes: int = VNODES, cell_bits: int = CELL_BITS) -> list[tuple[int, int]]:
    """(cell, shard) of all virtual nodes in clockwise order; their number is a parameter."""
    if shards < 1 or shards * vnodes > 1 << 20:
        raise ValueError("shards must be positive, and virtual nodes not above a million")
    n = spark.range(shards * vnodes).select((F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).cast("int").alias("v"))
    at = n.select(F.shiftrightunsigned(F.xxhash64(F.lit("ring"), "shard", "v"), 64 - cell_bits).cast("int").alias("cell"), "shard", F.xxhash64("v", "shard").alias("tie"))
    return [(r.cell, r.shard) for r in sorted(at.collect(), key=lambda r: (r.cell, r.tie))]


def walk(loads: dict[int, int], large: list[tuple[int, int, int]], nodes: list[tuple[int, int]], shards: int, slack: float) -> tuple[list[dict], list[dict]]:
    """(byte ranges of cells and their shards, shards of large documents). Large: (uid, cell, size). Everything goes
    clockwise to virtual nodes that have room; a large document that no shard has room for goes to the emptiest."""
    import bisect

    total = sum(loads.values()) + sum(n for _, _, n in large)
    room = [max(math.ceil(total / shards), math.floor(total / shards * (1 + slack)))] * shards
    cells = [c for c, _ in nodes]
    singles = []
    for uid, cell, n in sorted(large, key=lambda x: (-x[2], x[1], x[0])):
        k = bisect.bisect_left(cells, cell)
        s = next((s for _, s in nodes[k:] + nodes[:k] if room[s] >= n), max(range(shards), key=lambda s: (room[s], -s)))
        room[s] -= n
        singles.append({"uid": uid, "own": s})
    if (over := -sum(r for r in room if r < 0)) > 0:  # a document larger than a shard: the others take its share
        room = [max(0, r) + over for r in room]
    out = []
    for cell in sorted(loads):
        left, at, k = loads[cell], 0, bisect.bisect_left(cells, cell)
        while left:
            s = nodes[k % len(nodes)][1]
            if take := min(left, room[s]):
                out.append({"cell": cell, "lo": at, "hi": at + take, "shard": s})
                room[s] -= take
                at, left = at + take, left - take
            k += 1
    for x in out:  # the last range of a cell is open, for rounding
        if x["hi"] == loads[x["cell"]]:
            x["hi"] = (1 << 62)
    return out, singles


def assign_shards(docs: DataFrame, shards: int, slack: float = 0.001, vnodes: int = VNODES, cell_bits: int = CELL_BITS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard), for each row."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    point = F.xxhash64(body)
    base = docs.select(
        F.col(key).alias("doc_id"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), point.alias("point"),
        F.shiftrightunsigned(point, 64 - cell_bits).cast("int").alias("cell"),
    )
    base = save(base.withColumn("uid", F.monotonically_increasing_id()), "points")
    limit = (base.agg(F.sum("size")).first()[0] or 0) / shards / LARGE
    large = [(r.uid, r.cell, r.size) for r in base.where(F.col("size") > limit).select("uid", "cell", "size").collect()]  # LARGE * shards at most
    small = base.where(F.col("size") <= limit)
    hist = small.groupBy("cell").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()  # 2 ** cell_bits rows at most
    spans, singles = walk({r.cell: r.bytes for r in hist}, large, ring(spark, shards, vnodes, cell_bits), shards, slack)
    ranges = rows_table(spark, spans, "cell int, lo bigint, hi bigint, shard int")
    alone = base.join(F.broadcast(rows_table(spark, singles, "uid bigint, own int")), "uid")
    parts = rows_table(spark, [{"cell": r.cell, "parts": -(-r.rows // PART_ROWS)} for r in hist], "cell int, parts int")
    rows = small.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int"))
    ahead = Window.unboundedPreceding, -1
    sums = rows.groupBy("cell", "part").agg(F.sum("size").alias("bytes"))
    sums = sums.select("cell", "part", F.coalesce(F.sum("bytes").over(Window.partitionBy("cell").orderBy("part").rowsBetween(*ahead)), F.lit(0)).alias("base"))
    order = ("point", "doc_id", "size", "text_crc32")
    inside = Window.partitionBy("cell", "part").orderBy(*order)
    rows = rows.join(sums, ["cell", "part"]).withColumn("before", F.col("base") + F.coalesce(F.sum("size").over(inside.rowsBetween(*ahead)), F.lit(0)))
    middle = F.col("before") + F.floor(F.col("size") / 2)
    span = F.broadcast(ranges.withColumnRenamed("cell", "of"))  # a few more rows than there are cells
    rows = rows.join(span, (F.col("cell") == F.col("of")) & (middle >= F.col("lo")) & (middle < F.col("hi"))).select("doc_id", "size", "text_crc32", "point", "cell", "part", "before", "shard")
    alone = alone.select("doc_id", "size", "text_crc32", "point", "cell", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("before"), F.col("own").alias("shard"))
    placed = save(rows.union(alone), "placed")
    counts = placed.groupBy("shard", "cell", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("shard", "cell", "part", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("cell", "part").rowsBetween(*ahead)), F.lit(0)).alias("first"))
    nth = F.row_number().over(Window.partitionBy("shard", "cell", "part").orderBy("before", *order)) - 1
    return placed.join(counts, ["shard", "cell", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("first") + nth).alias("slot"))


def op10_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 of near equal bytes."""
    out = assign_shards(documents(spark, sf_dir), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
