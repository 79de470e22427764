"""Best-two-fit packing of documents into sequences of fixed capacity.

The rule: fill a bin greedily, largest document first, until nothing fits; then, where the bin holds more than one
document, replace its smallest by the two unpacked documents whose joint length fits the gap so widened most tightly.
What the rule does depends only on how many unpacked documents there are of each length, of which there are no more
than the capacity. So the rule runs on the histogram of lengths: a bin's pattern of lengths is repeated for as long as
the counts carry it, which is exactly what packing bin after bin would do. The driver sees `capacity` counts and the
plan has a few thousand patterns at any size of the corpus, and the whole corpus is packed as one lot. Documents find
their places by (length, rank among that length), and ranks come from counts by task and length, not from a sort.

Defined cases. Null text is empty; an empty document is its end id. Longer documents are cut into pieces of the
capacity, the last as long as what is left. Equal lengths are interchangeable, so ties fall as tasks read them.
Repeated rows and doc_ids, null doc_ids included, are packed as documents of their own. An empty table gives no rows.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, save, prepare, span_tokenizer

PIECES_DDL = "doc_id long, piece int, start long, length int, lot int, rank_in_lot int, ids binary"


def best_pair(avail: list[tuple[int, int]], more_than: int, most: int) -> tuple[int, int] | None:
    """Of the (length, count) in ascending order, the two lengths whose sum is largest in (more_than, most]."""
    import numpy as np

    n = np.array([x for x, _ in avail], "i8")
    c = np.array([x for _, x in avail], "i8")
    if not len(n):
        return None
    j = np.searchsorted(n, most - n, "right") - 1
    j = np.minimum(j, np.arange(len(n)))
    j = np.where((j == np.arange(len(n))) & (c < 2), j - 1, j)
    sums = np.where(j >= 0, n + n[np.maximum(j, 0)], -1)
    best = int(sums.max())
    if best <= more_than:
        return None
    k = int(np.flatnonzero(sums == best)[-1])
    return int(n[k]), int(n[j[k]])


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(copies of each length, number of such bins), in the order in which best-two-fit makes them."""
    import bisect

    left = {n: c for n, c in counts.items() if c > 0}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError("a length is outside 1 to the capacity")
    lengths = sorted(left)
    out = []
    while lengths:
        bin_, gap, at = {}, capacity, len(lengths)
        while gap and (at := bisect.bisect_right(lengths, gap, 0, at)):
            n = lengths[at - 1]
            bin_[n] = min(left[n], gap // n)
            gap -= n * bin_[n]
            at -= 1
        if gap and sum(bin_.values()) > 1:
            small = min(bin_)
            free = [(n, left[n] - bin_.get(n, 0)) for n in lengths if n < small + gap and left[n] > bin_.get(n, 0)]
            if pair := best_pair(free, small, small + gap):
                bin_[small] -= 1
                for n in pair:
                    bin_[n] = bin_.get(n, 0) + 1
                bin_ = {n: c for n, c in bin_.items() if c}
        times = min(left[n] // c for n, c in bin_.items())
        for n, c in bin_.items():
            left[n] -= c * times
            if not left[n]:
                del lengths[bisect.bisect_left(lengths, n)]
        out.append((bin_, times))
    return out


def slot_table(plan: list[tuple[dict[int, int], int]]) -> dict[str, list[int]]:
    """Rows (length, first rank, copies a bin, first sequence, offset) sorted by length and rank."""
    rows, rank, seq = [], {}, 0
    for bin_, times in plan:
        at = 0
        for n in sorted(bin_, reverse=True):
            c = bin_[n]
            rows.append((n, rank.get(n, 0), c, seq, at))
            rank[n] = rank.get(n, 0) + c * times
            at += c * n
        seq += times
    rows.sort()
    return {k: [r[i] for r in rows] for i, k in enumerate(("length", "rank", "copies", "seq", "offset"))}


def _pieces(batches: Iterator, tokenizer: str, spans: str, end_id: int, capacity: int) -> Iterator:
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    tok = span_tokenizer(tokenizer, spans, 4)
    end = np.array([end_id], "<u4").tobytes()
    lot, ranks = TaskContext.get().partitionId(), {}
    for b in batches:
        out: list[tuple] = []
        for doc, raw in zip(b.column(0).to_pylist(), tok.encode_all(b.column(1).to_pylist()), strict=True):
            raw += end
            for k in range(0, len(raw), 4 * capacity):
                part = raw[k : k + 4 * capacity]
                n = len(part) // 4
                ranks[n] = ranks.get(n, -1) + 1
                out.append((doc, k // (4 * capacity), k // 4, n, lot, ranks[n], part))
        yield pa.record_batch(
            [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))],
            ["doc_id", "piece", "start", "length", "lot", "rank_in_lot", "ids"],
        )


def _place(batches: Iterator, table: dict[str, list[int]]) -> Iterator:
    """Adds sequence_id and offset; the last two columns are length and rank."""
    import numpy as np
    import pyarrow as pa

    t = {k: np.array(v, "i8") for k, v in table.items()}
    keys = (t["length"] << 44) + t["rank"]
    for b in batches:
        n = b.column("length").to_numpy().astype("i8")
        rank = b.column("rank").to_numpy()
        k = np.searchsorted(keys, (n << 44) + rank, "right") - 1
        past = rank - t["rank"][k]
        seq = t["seq"][k] + past // t["copies"][k]
        offset = t["offset"][k] + past % t["copies"][k] * n
        yield pa.record_batch([*b.columns, pa.array(seq), pa.array(offset)], [*b.schema.names, "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048, spans: str = "word", key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(pieces, places). Pieces have the ids (little-endian unsigned 32-bit), in a table in the shared folder; places
    have doc_id, piece, start, length, the ids' checksum, sequence_id and offset. Both have (lot, length, rank_in_lot) as a key.

    Texts are encoded once, where they are read; no text and no ids are shuffled."""
    spark = docs.sparkSession
    prepare(spark)
    src = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    pieces = save(src.mapInArrow(lambda it: _pieces(it, tokenizer, spans, end_id, capacity), PIECES_DDL), "pieces")
    lots = pieces.groupBy("lot", "length").agg(F.count(F.lit(1)).alias("n"))
    hist = {r.length: r.n for r in lots.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `capacity` rows at most
    table = slot_table(plan_bins(hist, capacity))
    ahead = F.sum("n").over(Window.partitionBy("length").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1))
    base = lots.select("lot", "length", F.coalesce(ahead, F.lit(0)).alias("base"))
    cols = ["doc_id", "piece", "start", "ids_crc32", "lot", "rank_in_lot", "length"]
    ranked = pieces.withColumn("ids_crc32", F.crc32("ids")).select(*cols).join(base, ["lot", "length"])
    ranked = ranked.select(*cols, (F.col("base") + F.col("rank_in_lot")).alias("rank"))
    places = ranked.mapInArrow(lambda it: _place(it, table), "doc_id long, piece int, start long, ids_crc32 long, lot int, rank_in_lot int, length int, rank long, sequence_id long, offset long")
    return pieces, places.drop("rank")


def sequences(pieces: DataFrame, places: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, ids (little-endian unsigned 32-bit), doc_ids, offsets. A sequence holds no
    more than `capacity` ids, so its group is bounded."""
    key = ["lot", "length", "rank_in_lot"]
    rows = places.select(*key, "doc_id", "sequence_id", "offset").join(pieces.select(*key, "ids"), key)
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return (
        rows.groupBy("sequence_id").agg(parts.alias("parts"))
        .select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"), F.col("parts.doc_id").alias("doc_ids"), F.col("parts.offset").alias("offsets"))
    )


def packed_rows(docs: DataFrame) -> DataFrame:
    """Places with the checksum of each piece's ids, by the contract's tokenizer."""
    import public_tokenizers

    _, places = pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=0)
    return places.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def op2_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 ids."""
    return packed_rows(documents(spark, sf_dir))
