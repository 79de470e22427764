"""A supervised quality classifier: learned vectors of hashed words and character n-grams, averaged over a document,
with a softmax over the two classes, trained by stochastic gradient descent in numpy.

Features of a word: the word, and its character n-grams of 3 to 5 with ends marked, hashed into a fixed number of
buckets. A word equal to the one before it adds the pair of equal words, a bigram that all such words share.

Training sees a bounded sample: `sample` doc_ids of each class at most (2000 unless told otherwise), the first by a hash
of doc_id, each with one text (of several, that of the smallest hash), and never rows whose crc32 of doc_id leaves 1 on division by 3. It runs in one task over that sample.
The model is linear in the averaged features, so vectors and softmax weights come down to one number a bucket, which
is what tasks get, and a document's log odds are a mean over its words of numbers kept by word.

Defined cases. Null and empty texts have no features and score 0.5. A null doc_id is not held out. Labels that are
neither 0 nor 1 are left out; a label without a document isn't used; with labels of no or one class all scores are
0.5. Repeated rows score alike. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, prepare

BUCKETS = 1 << 18
DIM = 16
SAMPLE = 2000
EPOCHS = 6
RATE = 0.8
_PAIR = zlib.crc32(b"\x00pair") % BUCKETS


def word_buckets(word: bytes) -> list[int]:
    """Buckets of a word and its n-grams, over the characters' UTF-8."""
    crc, mask, text = zlib.crc32, BUCKETS - 1, b"<" + word + b">"
    if word.isascii():
        grams = [text[i : i + n] for n in (3, 4, 5) for i in range(len(text) - n + 1)]
    else:
        chars = text.decode("utf-8", "replace")
        grams = [chars[i : i + n].encode() for n in (3, 4, 5) for i in range(len(chars) - n + 1)]
    return [crc(word) & mask, *[crc(g, 1) & mask for g in grams]]


def document_buckets(text: str | None):
    """(buckets, shares) of a document's average."""
    import numpy as np

    words = (text or "").encode("utf-8", "surrogatepass").split()
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    ids, n = [], []
    for w, c in counts.items():
        b = word_buckets(w)
        ids += b
        n += [c] * len(b)
    if same := sum(a == b for a, b in zip(words, words[1:], strict=False)):
        ids.append(_PAIR)
        n.append(same)
    if not ids:
        return np.empty(0, "i8"), np.empty(0)
    ids, at = np.unique(np.array(ids), return_inverse=True)
    n = np.bincount(at, np.array(n, "f8"))
    return ids, n / n.sum()


def train(docs: list[tuple[object, object, int]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 7):
    """Log odds of class 1 for each bucket, from (buckets, shares, label)."""
    import numpy as np

    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    out = np.zeros((2, DIM))
    docs = [d for d in docs if len(d[0])]
    if len({y for _, _, y in docs}) < 2:
        return np.zeros(BUCKETS, "f4")
    steps, done = epochs * len(docs), 0
    for _ in range(epochs):
        for k in rng.permutation(len(docs)):
            ids, share, y = docs[k]
            lr = rate * (1 - done / steps)
            rows = vectors[ids]
            hidden = share @ rows
            z = out @ hidden
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            grad = p @ out
            out -= lr * np.outer(p, hidden)
            vectors[ids] = rows - lr * len(ids) ** 0.5 * np.outer(share, grad)
            done += 1
    return (vectors @ (out[1] - out[0])).astype("f4")


def _train(batches: Iterator) -> Iterator:
    import pyarrow as pa

    docs = [(*document_buckets(t), y) for b in batches for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    yield pa.record_batch([pa.array([train(docs).tobytes()], pa.binary())], ["model"])


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "quality", key: str = "doc_id", text: str = "text") -> bytes:
    """The model: one little-endian float a bucket. One scan of docs, with the chosen ids (2 * sample at most) sent to
    all tasks."""
    prepare(docs.sparkSession)
    own = labels.select(F.col(key).cast("long").alias("id"), F.col(label).cast("int").alias("y")).where(F.col("id").isNotNull() & ~held_out(F.col("id")))
    own = own.distinct()
    chosen = [own.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample) for y in (0, 1)]
    src = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    rows = src.join(F.broadcast(chosen[0].union(chosen[1])), "id").withColumn("h", F.xxhash64("text"))
    # one text for each chosen id and label: 2 * sample rows at most
    rows = rows.groupBy("id", "y").agg(F.min(F.struct("h", "text")).alias("least"))
    rows = rows.orderBy("id", "y").select("least.text", "y").coalesce(1)
    got = rows.mapInArrow(_train, "model binary").first()
    return bytes(got.model) if got else b"\0" * (4 * BUCKETS)


_kept: dict[bytes, tuple] = {}


def _score(batches: Iterator, model) -> Iterator:
    import numpy as np
    import pyarrow as pa

    raw = model.value
    odds = np.frombuffer(raw, "f4").astype("f8")
    of = odds.tolist().__getitem__  # quicker than numpy for the few buckets of a word
    tag = raw[:64] + zlib.crc32(raw).to_bytes(4, "little")
    if tag not in _kept:
        _kept.clear()
        cap = 300_000
        _kept[tag] = ({}, np.zeros(cap), np.zeros(cap))
    seen, total, size = _kept[tag]
    pair = odds[_PAIR]
    for b in batches:
        out = []
        for t in b.column(1):
            words = (t.as_py() or "").encode("utf-8", "surrogatepass").split()
            if not words:
                out.append(0.5)
                continue
            fresh = set(words).difference(seen)
            if len(seen) + len(fresh) > len(total):
                seen.clear()
                fresh = set(words)
            if len(fresh) > len(total):  # more words than the table holds: a document on its own
                ids, share = document_buckets(t.as_py())
                z = float(share @ odds[ids])
            else:
                for w in fresh:
                    f = word_buckets(w)
                    i = seen[w] = len(seen)
                    total[i], size[i] = sum(map(of, f)), len(f)
                i = np.fromiter(map(seen.__getitem__, words), "i8", len(words))
                same = int((i[1:] == i[:-1]).sum())
                z = (total[i].sum() + same * pair) / (size[i].sum() + same)
            out.append(1 / (1 + np.exp(-z)))
        yield pa.record_batch([b.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])


def score(docs: DataFrame, model: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score, for each row, in one scan."""
    spark = docs.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(model)  # 4 bytes a bucket, whatever the data
    src = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(lambda it: _score(it, sent), "doc_id long, score double")


def op6_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from labels outside the held-out third."""
    docs = documents(spark, sf_dir)
    out = score(docs, fit(docs, documents(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _keep(batches: Iterator, model, at: int) -> Iterator:
    import pyarrow as pa
    import pyarrow.compute as pc

    for b in batches:
        text = pa.RecordBatch.from_arrays([b.column(at), b.column(at)], ["a", "b"])
        scored = next(_score(iter([text]), model))
        yield b.filter(pc.greater_equal(scored.column(1), 0.5))


def keep(docs: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """The rows whose score is 0.5 or more, with all their columns; one scan, no join."""
    spark = docs.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text)
    return docs.mapInArrow(lambda it: _keep(it, sent, at), docs.schema)
