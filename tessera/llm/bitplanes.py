"""Token ids on disk as shuffled bit planes.

Documents are encoded, placed into shards by ranges of doc_id, and each shard's stream of ids is cut into blocks of a
fixed number of ids. A block is transposed: plane b holds bit b (or byte b) of all its ids, and each plane is
compressed with zstandard on its own, since the high planes of token ids are far more regular than the low ones.

The container is a Parquet folder that Spark commits, so any store that Spark writes serves, failed and speculative
attempts leave nothing behind, and blocks can be read in any order. One row is one block:

    shard, chunk          place of the block; chunks of a shard follow one another
    first_id, n_ids       the block's part of the shard's stream
    mode, planes          "bit" or "byte"; compressed planes, lowest first
    crc32                 of the block's ids as little-endian unsigned 32-bit integers
    doc_ids, doc_seqs, doc_offsets, doc_lengths
                          the chunk index: the segments of documents in the block, in order

Defined cases. Null text is empty and so encodes as the end id alone. Null doc_id sorts first. Repeated doc_ids stay
separate documents, in order of their ids. An empty table gives an empty container. Other columns are ignored,
whatever their names. Very long texts cross blocks; their segments are joined on reading.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc32_join, new_path, parallelism, prepare, span_tokenizer, vocabulary_width

BLOCK_IDS = 1 << 16
SHARD_DOCS = 50_000
#: Shards, and so the quantiles that the driver asks for and their sketch, stay below this; larger corpora have larger shards.
MOST_SHARDS = 8192
CHUNK_DDL = (
    "shard int, chunk int, first_id long, n_ids int, mode string, planes array<binary>, crc32 long, "
    "doc_ids array<long>, doc_seqs array<long>, doc_offsets array<int>, doc_lengths array<int>"
)


def to_planes(ids, mode: str = "bit", level: int = 3) -> list[bytes]:
    """The compressed planes of an array of ids; as many as the largest id needs, one at least."""
    import numpy as np
    import zstandard

    z = zstandard.ZstdCompressor(level=level)
    ids = np.ascontiguousarray(ids, "<u4")
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    if mode == "byte":
        by = ids.view("u1").reshape(-1, 4)
        return [z.compress(by[:, k].tobytes()) for k in range(-(-bits // 8))]
    return [z.compress(np.packbits((ids >> np.uint32(k)) & np.uint32(1) != 0).tobytes()) for k in range(bits)]


def from_planes(planes: list[bytes], n: int, mode: str = "bit"):
    import numpy as np
    import zstandard

    z = zstandard.ZstdDecompressor()
    ids = np.zeros(n, "<u4")
    for k, plane in enumerate(planes):
        raw = np.frombuffer(z.decompress(plane), "u1")
        if mode == "byte":
            ids |= raw.astype("<u4") << np.uint32(8 * k)
        else:
            ids |= np.unpackbits(raw, count=n).astype("<u4") << np.uint32(k)
    return ids


def shard_bounds(docs: DataFrame, key: str, shards: int) -> list[float]:
    """Upper bounds of all shards but the last; one number a shard comes to the driver. Null keys go to shard 0."""
    if shards < 2:
        return []
    probs = [k / shards for k in range(1, shards)]
    return sorted(set(docs.select(F.col(key).cast("double").alias("k")).approxQuantile("k", probs, 0.1 / shards)))


def _encode(batches: Iterator, tokenizer: str, spans: str, width: int, end_id: int, bounds: list[float]) -> Iterator:
    import numpy as np
    import pyarrow as pa

    tok = span_tokenizer(tokenizer, spans, width)
    end = np.array([end_id], tok.dtype).tobytes()
    edges = np.array(bounds, "f8")
    for b in batches:
        key = b.column(0)
        at = np.array([0 if k is None else int(np.searchsorted(edges, float(k), "left")) for k in key.to_pylist()], "i4")
        ids = pa.array([x + end for x in tok.encode_all(b.column(1).to_pylist())], pa.binary())
        yield pa.record_batch([pa.array(at), key, ids], ["shard", "doc_id", "ids"])


def _write_blocks(batches: Iterator, width: int, block: int, mode: str, level: int) -> Iterator:
    """One shard's documents, or several shards' one after another, as rows of blocks."""
    import numpy as np
    import pyarrow as pa

    shard, seq, chunk, first = None, 0, 0, 0
    held: list = []
    segments: list[tuple] = []
    fill = 0

    def block_row():
        nonlocal held, segments, fill, chunk, first
        ids = np.concatenate(held)
        row = {
            "shard": shard, "chunk": chunk, "first_id": first, "n_ids": len(ids), "mode": mode, "planes": to_planes(ids, mode, level), "crc32": zlib.crc32(ids.tobytes()),
            "doc_ids": [s[0] for s in segments], "doc_seqs": [s[1] for s in segments], "doc_offsets": [s[2] for s in segments], "doc_lengths": [s[3] for s in segments],
        }
        held, segments, fill, chunk, first = [], [], 0, chunk + 1, first + len(ids)
        return row

    schema = pa.schema([
        ("shard", pa.int32()), ("chunk", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int32()), ("mode", pa.string()), ("planes", pa.list_(pa.binary())), ("crc32", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())), ("doc_seqs", pa.list_(pa.int64())), ("doc_offsets", pa.list_(pa.int32())), ("doc_lengths", pa.list_(pa.int32())),
    ])
    for b in batches:
        rows = []
        for s, doc, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            if s != shard:
                if fill:
                    rows.append(block_row())
                shard, seq, chunk, first = s, 0, 0, 0
            ids = np.frombuffer(raw.as_buffer(), f"<u{width}").astype("<u4")
            at = 0
            while at < len(ids):
                take = min(block - fill, len(ids) - at)
                held.append(ids[at : at + take])
                segments.append((doc, seq, fill, take))
                fill, at = fill + take, at + take
                if fill == block:
                    rows.append(block_row())
            seq += 1
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)
    if fill:
        yield pa.RecordBatch.from_pylist([block_row()], schema)


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int | None, spans: str = "byte", key: str = "doc_id", text: str = "text",
    block_ids: int = BLOCK_IDS, shard_docs: int = SHARD_DOCS, mode: str = "bit", level: int = 3,
) -> None:
    """Encodes docs and writes the container to path, in ascending order of key.

    Shards hold about shard_docs documents (more where that makes over MOST_SHARDS of them, fewer where the session has more shuffle partitions than that makes). Ids
    cross the network once, two bytes each where the vocabulary allows it."""
    spark = docs.sparkSession
    prepare(spark)
    if end_id is None:
        raise ValueError("an end id is needed: it keeps every document in the stream")
    width = max(vocabulary_width(tokenizer), 2 if end_id < 1 << 16 else 4)
    src = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    n = docs.select(F.count(F.lit(1))).first()[0]
    shards = min(MOST_SHARDS, max(1, math.ceil(n / shard_docs), min(parallelism(spark), math.ceil(n / 500))))
    bounds = shard_bounds(src, "doc_id", shards)
    encoded = src.mapInArrow(lambda it: _encode(it, tokenizer, spans, width, end_id, bounds), "shard int, doc_id long, ids binary")
    placed = encoded.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "ids")
    blocks = placed.mapInArrow(lambda it: _write_blocks(it, width, block_ids, mode, level), CHUNK_DDL)
    blocks.write.option("compression", "uncompressed").parquet(path)


def _read_blocks(batches: Iterator, with_ids: bool) -> Iterator:
    import pyarrow as pa

    for b in batches:
        out: dict[str, list] = {k: [] for k in ("shard", "seq", "doc_id", "first", "n", "crc", "ids")}
        for r in (r for at in range(0, b.num_rows, 16) for r in b.slice(at, 16).to_pylist()):  # blocks are large
            ids = from_planes(r["planes"], r["n_ids"], r["mode"])
            if zlib.crc32(ids.tobytes()) != r["crc32"]:
                raise ValueError(f"block {r['chunk']} of shard {r['shard']} is damaged")
            for doc, seq, at, n in zip(r["doc_ids"], r["doc_seqs"], r["doc_offsets"], r["doc_lengths"], strict=True):
                raw = ids[at : at + n].tobytes()
                for k, v in (("shard", r["shard"]), ("seq", seq), ("doc_id", doc), ("first", r["first_id"] + at), ("n", n), ("crc", zlib.crc32(raw)), ("ids", raw if with_ids else None)):
                    out[k].append(v)
        yield pa.record_batch(
            [pa.array(out[k], t) for k, t in (("shard", pa.int32()), ("seq", pa.int64()), ("doc_id", pa.int64()), ("first", pa.int64()), ("n", pa.int64()), ("crc", pa.int64()), ("ids", pa.binary()))],
            list(out),
        )


def _join_segments(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b in batches:
        crcs, ids = [], []
        for parts in b.column(5).to_pylist():
            parts.sort(key=lambda p: p["first"])
            crc = parts[0]["crc"]
            for p in parts[1:]:
                crc = crc32_join(crc, p["crc"], 4 * p["n"])
            crcs.append(crc)
            ids.append(None if parts[0]["ids"] is None else b"".join(p["ids"] for p in parts))
        yield pa.record_batch([*b.columns[:5], pa.array(crcs, pa.int64()), pa.array(ids, pa.binary())], ["shard", "seq", "doc_id", "first", "n_tokens", "ids_crc32", "ids"])


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """The documents of a container: doc_id, start, n_tokens, ids_crc32, ids (little-endian unsigned 32-bit).

    Blocks decode independently of one another; a block's checksum is verified. Segments are gathered by document, and
    start is the shard's start (a running sum over one row a shard) plus the place in the shard."""
    from pyspark.sql.types import StructType

    prepare(spark)
    blocks = spark.read.schema(StructType.fromDDL(CHUNK_DDL)).parquet(path)
    base = blocks.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    base = base.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("base"))
    parts = blocks.mapInArrow(lambda it: _read_blocks(it, with_ids), "shard int, seq long, doc_id long, first long, n long, crc long, ids binary")
    whole = parts.groupBy("shard", "seq", "doc_id").agg(F.min("first").alias("first"), F.sum("n").alias("n_tokens"), F.collect_list(F.struct("first", "n", "crc", "ids")).alias("parts"))
    whole = whole.mapInArrow(_join_segments, "shard int, seq long, doc_id long, first long, n_tokens long, ids_crc32 long, ids binary")
    return whole.join(base, "shard").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", "ids")


def op1_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, written as bit planes and read back from them."""
    import public_tokenizers

    from .common import documents

    path = new_path(spark, "tokens")
    write_tokens(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_tokens(spark, path, with_ids=False).drop("ids")


