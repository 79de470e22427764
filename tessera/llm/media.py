"""Media payloads as content-defined chunks, stored once and put together again from ordered chunk lists.

A rolling gear hash (the last 64 bytes decide) cuts a payload where its value has ten zero bits, between a least and a
largest chunk size; equal passages so make equal chunks wherever they stand. Chunks are known by a 128-bit digest.

The store is two Parquet folders. `media` has a row for each medium: its ordered chunk list (digests and lengths, the
recipe) and, in line, the bytes of those chunks that no other place of the corpus has. `chunks` has every shared chunk
once. Which digests are shared comes from a count over digests alone. That is a join's worth of answers, and payloads
shouldn't cross the network to meet it, so tasks get the shared digests as a Bloom filter of fixed size. A false
positive, or a filter that a vast corpus overfills, only sends a few more chunks the shared way, which is right for
any chunk: shared chunks are deduplicated by digest in one exchange, and joined back by digest on reading.

Reading verifies every chunk against its digest and the whole against its length.

Defined cases. Null text is empty. A payload is UTF-8, filled with bytes 0 to a positive multiple of 64. Rows that
repeat a doc_id, or have none, are media of their own. Equal texts have equal recipes and values. An empty table gives
empty folders. Other columns are ignored, whatever their names. A very long text is one medium with many chunks.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import ARROW_BYTES, ARROW_ROWS, documents, new_path, prepare

LEAST, MOST, MASK_BITS = 256, 8192, 10
BLOOM_BITS = 1 << 26
BLOOM_HASHES = 4
MEDIA_DDL = "uid long, doc_id long, n_bytes long, recipe binary, shared binary, body binary"
CHUNK_DDL = "digest binary, payload binary"


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))


@lru_cache(maxsize=1)
def gear():
    import numpy as np

    return np.random.default_rng(64).integers(0, 1 << 64, 256, "u8", endpoint=False)


def rolling(payload: bytes):
    """The gear hash after each byte: h = 2h + gear[byte] modulo 2 ** 64, over whole arrays by doubling windows."""
    import numpy as np

    h = gear()[np.frombuffer(payload, "u1")]
    for w in (1, 2, 4, 8, 16, 32):
        if len(h) <= w:
            break
        more = h.copy()
        more[w:] += h[:-w] << np.uint64(w)
        h = more
    return h


def cuts(payload: bytes, least: int = LEAST, most: int = MOST, bits: int = MASK_BITS) -> list[int]:
    """Ends of the chunks."""
    import numpy as np

    out, at, n = [], 0, len(payload)
    if n > least:
        marks = []
        for lo in range(0, n, 1 << 20):  # long payloads in parts, each with the 64 bytes before it
            from_ = max(0, lo - 64)
            h = rolling(payload[from_ : lo + (1 << 20)])[lo - from_ :]
            marks += (np.flatnonzero(h >> np.uint64(64 - bits) == 0) + lo + 1).tolist()
        for m in marks:
            while m - at > most:
                at += most
                out.append(at)
            if m - at >= least:
                at = m
                out.append(at)
        while n - at > most:
            at += most
            out.append(at)
    if at < n:
        out.append(n)
    return out


def chunks_of(payload: bytes) -> list[tuple[bytes, bytes]]:
    """(digest, bytes) in order."""
    at, out = 0, []
    for end in cuts(payload):
        part = payload[at:end]
        out.append((hashlib.blake2b(part, digest_size=16).digest(), part))
        at = end
    return out


def _digests(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b in batches:
        seen: dict[bytes, int] = {}
        for t in b.column(0):
            for d, _ in chunks_of(payload_of(t.as_py())):
                seen[d] = seen.get(d, 0) + 1
        yield pa.record_batch([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["digest", "n"])


def bloom(shared: DataFrame, bits: int = BLOOM_BITS) -> bytes:
    """A Bloom filter of a column of digests; its size is fixed, and bits / 64 rows come to the driver at most."""
    import numpy as np

    half = [F.conv(F.hex(F.substring("digest", 1 + 4 * k, 4)), 16, 10).cast("long") % bits for k in range(BLOOM_HASHES)]
    spots = shared.select(F.explode(F.array(*half)).alias("bit"))
    words = spots.groupBy(F.shiftright("bit", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 32 AS int))")).alias("set"))
    got = words.select(F.col("word").cast("int").alias("word"), "set").toArrow()
    table = np.zeros(bits // 32, "<u4")
    table[got.column("word").to_numpy()] = got.column("set").to_numpy().astype("<u4")
    return table.tobytes()


def _packs(batches: Iterator, filter_) -> Iterator:
    """Rows of both folders: kind 0 is a medium, kind 1 a shared chunk, which each task writes once as a rule."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    table = np.frombuffer(filter_.value, "<u4")
    bits = len(table) * 32
    uid = TaskContext.get().partitionId() << 40
    told: set[bytes] = set()
    for b in batches:
        rows: list[tuple] = []
        for doc, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            payload = payload_of(t.as_py())
            parts = chunks_of(payload)
            spots = np.frombuffer(b"".join(d for d, _ in parts), ">u4").astype("i8") % bits
            held = ((table[spots >> 5] >> (spots & 31).astype("u4")) & 1).reshape(-1, BLOOM_HASHES).all(axis=1)
            n = len((t.as_py() or "").encode("utf-8", "surrogatepass"))
            recipe = b"".join(d + struct.pack("<I", len(p)) for d, p in parts)
            rows.append((0, uid, doc, n, recipe, held.astype("u1").tobytes(), b"".join(p for (_, p), h in zip(parts, held, strict=True) if not h), None, None))
            uid += 1
            for (d, p), h in zip(parts, held, strict=True):
                if h and d not in told:
                    if len(told) > 200_000:
                        told.clear()
                    told.add(d)
                    rows.append((1, None, None, None, None, None, None, d, p))
        types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 5)
        names = ("kind", "uid", "doc_id", "n_bytes", "recipe", "shared", "body", "digest", "payload")
        yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(types)], list(names))


def write_media(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> None:
    """Stores the payloads of all rows under path: media/kind=0 and chunks."""
    spark = docs.sparkSession
    prepare(spark)
    src = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    digests = src.select("text").mapInArrow(_digests, "digest binary, n long")
    shared = digests.groupBy("digest").agg(F.sum("n").alias("n")).where("n > 1")
    sent = spark.sparkContext.broadcast(bloom(shared))
    rows = src.mapInArrow(lambda it: _packs(it, sent), f"kind int, {MEDIA_DDL}, {CHUNK_DDL}")
    rows.write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/media")
    folders = [spark._jvm.org.apache.hadoop.fs.Path(f"{path}/media/kind={k}") for k in (0, 1)]
    store = folders[0].getFileSystem(spark._jsc.hadoopConfiguration())
    for f in folders:  # either may have had no rows
        store.mkdirs(f)
    once = spark.read.schema(StructType.fromDDL(CHUNK_DDL)).parquet(f"{path}/media/kind=1")
    once.groupBy("digest").agg(F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/chunks")
    store.delete(folders[1], True)


def _verified(digest: bytes, part: bytes) -> bytes:
    if hashlib.blake2b(part, digest_size=16).digest() != digest:
        raise ValueError("a stored chunk is damaged")
    return part


def _media(batches: Iterator) -> Iterator[tuple[int | None, int, bytes, bytes]]:
    """(doc_id, n_bytes, recipe, payload) of (doc_id, n_bytes, recipe, shared, body, parts: the distinct shared chunks),
    a medium at a time: one of few chunks that come again and again is far longer than what it is put together from."""
    for b in batches:
        for doc, n_bytes, recipe, shared, body, parts in zip(*b.columns, strict=True):
            recipe, body = recipe.as_py(), body.as_py()
            got = {p["digest"]: _verified(p["digest"], p["payload"]) for p in parts.as_py() or ()}
            at, whole = 0, []
            for k, held in enumerate(shared.as_py()):
                digest, (n,) = recipe[20 * k : 20 * k + 16], struct.unpack_from("<I", recipe, 20 * k + 16)
                if held:
                    whole.append(got[digest])
                else:
                    whole.append(_verified(digest, body[at : at + n]))
                    at += n
            yield doc.as_py(), n_bytes.as_py(), recipe, b"".join(whole)


def _rebuild(batches: Iterator) -> Iterator:
    """Media as they are, in batches of bounded bytes and rows."""
    import pyarrow as pa

    types = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
    pack = lambda rows: pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(types)], ["doc_id", "n_bytes", "recipe", "payload"])
    rows, size = [], 0
    for r in _media(batches):
        more = len(r[2]) + len(r[3])
        if rows and (size + more > ARROW_BYTES or len(rows) >= ARROW_ROWS):
            yield pack(rows)
            rows, size = [], 0
        rows.append(r)
        size += more
    yield pack(rows)


def read_media(spark: SparkSession, path: str, take: Callable[[Iterator], Iterator] = _rebuild, ddl: str = "doc_id long, n_bytes long, recipe binary, payload binary") -> DataFrame:
    """doc_id, n_bytes, recipe and payload of all media, put together from the store. What goes over the payloads next
    can take them from _media as `take`, with its own ddl: then they don't leave the worker that puts them together.

    Media without shared chunks are read where they lie. For the others digests go to the chunks, and come back with
    them to the medium; a list holds one medium's chunks."""
    prepare(spark)
    media = spark.read.schema(StructType.fromDDL(MEDIA_DDL)).parquet(f"{path}/media/kind=0")
    chunks = spark.read.schema(StructType.fromDDL(CHUNK_DDL)).parquet(f"{path}/chunks")
    some = F.replace(F.hex("shared"), F.lit("00"), F.lit("")) != ""
    each = F.transform(F.sequence(F.lit(0), F.length("shared") - 1), lambda k: F.when(F.substr(F.col("shared"), k + 1, F.lit(1)) == F.lit(b"\x01"), F.substr(F.col("recipe"), 20 * k + 1, F.lit(16))))
    refs = media.where(some).select("uid", F.explode(F.array_distinct(F.array_compact(each))).alias("digest"))
    found = refs.join(chunks, "digest").groupBy("uid").agg(F.collect_list(F.struct("digest", "payload")).alias("parts"))
    cols = ("doc_id", "n_bytes", "recipe", "shared", "body")
    none = media.where(~some).select(*cols, F.lit(None).cast("array<struct<digest: binary, payload: binary>>").alias("parts"))
    more = media.where(some).join(found, "uid").select(*cols, "parts")
    return none.mapInArrow(take, ddl).union(more.mapInArrow(take, ddl))


def feature(payload: bytes) -> str:
    """Mean, deviation and the shares of eight equal value ranges of 8-bit samples, from a count of each value."""
    import numpy as np

    x, counts, values = np.frombuffer(payload, "u1"), np.zeros(256, "i8"), np.arange(256)
    for lo in range(0, len(x), 1 << 20):  # counting takes 8 bytes a sample
        counts += np.bincount(x[lo : lo + (1 << 20)], minlength=256)
    mean = counts @ values / len(x)
    std = np.sqrt(counts @ (values - mean) ** 2 / len(x))
    return f"mean={mean:.4f};std={std:.4f};hist=" + ",".join(f"{s:.4f}" for s in counts.reshape(8, 32).sum(axis=1) / len(x))


FEATURES_DDL = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _features(batches: Iterator) -> Iterator:
    import pyarrow as pa

    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    names = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    for b in batches:
        rows = []
        for doc, n, recipe, payload in _media([b]):
            stored = hashlib.sha256(recipe)
            stored.update(payload)
            rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(recipe) + len(payload), stored.hexdigest(), feature(payload)))
        yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(types)], list(names))


def op9_chunked_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as media, read back and described. The stored form is the recipe and then its chunks."""
    path = new_path(spark, "media")
    write_media(documents(spark, sf_dir), path)
    return read_media(spark, path, _features, FEATURES_DDL)
