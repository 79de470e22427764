"""Operators 3 and 9 against brute force and exact round trips."""

import hashlib
import random
import struct
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import ann, media
from tessera.llm.common import ARROW_BYTES, new_path


def slow_cuts(p):
    h, at, out = 0, 0, []
    for i, c in enumerate(p):
        h = (2 * h + int(media.gear()[c])) % 2**64
        if i + 1 - at == media.MOST or i + 1 - at >= media.LEAST and h >> (64 - media.MASK_BITS) == 0:
            at = i + 1
            out.append(at)
    return out + [len(p)] * (at < len(p))


@given(st.integers(0, 2**32), st.integers(1, 30_000), st.integers(1, 256))
@settings(max_examples=25, deadline=None)
def test_cuts_are_those_of_a_rolling_hash(seed, n, values):
    p = bytes(random.Random(seed).choices(range(values), k=n))
    assert media.cuts(p) == slow_cuts(p)


def test_long_payload_is_cut_alike_in_parts():
    p = random.Random(1).randbytes(3 << 20)
    assert media.cuts(p) == slow_cuts(p)


def test_media_round_trip(spark, corpus):
    df, rows = corpus
    passage = " ".join(str(k) for k in range(2000))  # shared by documents in different places
    df = df.select("doc_id", "text").union(spark.createDataFrame([(800 + k, f"{k} " * (k + 1) + passage) for k in range(20)], "doc_id long, text string")).repartition(5)
    texts = [t for _, t, _ in rows] + [f"{k} " * (k + 1) + passage for k in range(20)]
    path = new_path(spark, "m")
    media.write_media(df.withColumn("payload", F.lit(1)), path)
    got = media.read_media(spark, path).collect()
    assert Counter(bytes(r.payload) for r in got) == Counter(media.payload_of(t) for t in texts)
    assert all(len(r.payload) % 64 == 0 and r.payload for r in got)
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count() > 0
    stored = chunks.agg(F.sum(F.length("payload"))).first()[0] + spark.read.parquet(f"{path}/media/kind=0").agg(F.sum(F.length("body"))).first()[0]
    distinct = {d: len(p) for t in texts for d, p in media.chunks_of(media.payload_of(t))}
    assert stored == sum(distinct.values())


def test_overfull_filter_still_gives_everything(spark, corpus, monkeypatch):
    df, rows = corpus
    monkeypatch.setattr(media, "bloom", lambda shared, bits=0: b"\xff" * 128)  # all chunks take the shared way
    path = new_path(spark, "m")
    media.write_media(df, path)
    assert Counter(bytes(r.payload) for r in media.read_media(spark, path).collect()) == Counter(media.payload_of(t) for _, t, _ in rows)


def test_damage_is_noticed():
    with pytest.raises(ValueError):
        media._verified(hashlib.blake2b(b"a", digest_size=16).digest(), b"b")


def test_media_features(spark, tmp_path):
    spark.createDataFrame([(1, "abc"), (2, "abc"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in media.op9_chunked_media(spark, str(tmp_path)).collect()}
    p = b"abc" + b"\0" * 61
    assert (got[1].n_bytes, got[1].payload_bytes, got[1].payload_sha256, got[1].tail_crc32) == (3, 64, hashlib.sha256(p).hexdigest(), zlib.crc32(p))
    assert got[1][2:] == got[2][2:] and got[3].payload_bytes == 64 and got[3].n_bytes == 0


def stored(n, repeats):
    """A batch as _rebuild gets it: n media of one shared chunk that comes again and again."""
    part = bytes(range(256)) * 32
    d = hashlib.blake2b(part, digest_size=16).digest()
    recipe = (d + struct.pack("<I", len(part))) * repeats
    kind = pa.list_(pa.struct([("digest", pa.binary()), ("payload", pa.binary())]))
    cols = [pa.array(range(n), pa.int64()), pa.array([len(part) * repeats] * n, pa.int64()), pa.array([recipe] * n), pa.array([b"\1" * repeats] * n), pa.array([b""] * n), pa.array([[{"digest": d, "payload": part}]] * n, kind)]
    return part * repeats, pa.record_batch(cols, ["doc_id", "n_bytes", "recipe", "shared", "body", "parts"])


def test_media_longer_than_their_chunks_leave_in_bounded_batches():
    payload, batch = stored(60, 100)
    got = list(media._rebuild([batch]))
    assert max(b.nbytes for b in got) <= ARROW_BYTES + (1 << 16) and sum(b.nbytes for b in got) > 5 * ARROW_BYTES
    assert [i for b in got for i in b.column(0).to_pylist()] == list(range(60))
    assert all(p == payload for b in got for p in b.column(3).to_pylist())
    assert sum(b.num_rows for b in media._rebuild([stored(2, 2000)[1]])) == 2  # each above the bound by itself
    assert [b.num_rows for b in media._rebuild([])] == [0]


def test_features_of_media_need_one_at_a_time():
    """Put together and described in one pass, the peak is that of one medium and not of its batch."""
    payload, batch = stored(60, 100)
    tracemalloc.start()
    (got,) = media._features([batch])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 * len(payload) < 60 * len(payload)
    assert got.column(0).to_pylist() == list(range(60)) and set(got.column(3).to_pylist()) == {hashlib.sha256(payload).hexdigest()}


def test_payloads_are_described_where_they_are_put_together(spark, tmp_path):
    """No plan of op9 hands payloads from one Python worker to the next."""
    spark.createDataFrame([(1, "abc"), (2, "abc")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = media.op9_chunked_media(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    depth = [len(line) - len(line.lstrip(" :+-|")) for line in plan.splitlines() if "MapInArrow" in line]
    assert len(depth) == 2 == depth.count(depth[0])


@given(st.binary(min_size=1, max_size=400), st.sampled_from([1, 3, 9000]))
@settings(max_examples=40, deadline=None)
def test_feature_against_all_samples(raw, times):
    x = np.frombuffer(raw * times, "u1")
    mean, std, hist = (part.split("=")[1] for part in media.feature(raw * times).split(";"))
    assert abs(float(mean) - x.mean()) < 1e-4 and abs(float(std) - x.astype("f8").std()) < 1e-4
    assert np.allclose([float(v) for v in hist.split(",")], [((x >= 32 * k) & (x < 32 * k + 32)).mean() for k in range(8)], atol=1e-4)


def test_media_empty(spark, empty):
    path = new_path(spark, "m")
    media.write_media(empty, path)
    assert media.read_media(spark, path).count() == 0


def vectors(n, dim=16, seed=0, clusters=10):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(clusters, dim))[rng.integers(0, clusters, n)] + 0.3 * rng.normal(size=(n, dim))).astype("f4")


def brute(ids, x, q, k):
    d = np.sqrt(((x.astype("f8") - x[q].astype("f8")) ** 2).sum(axis=1))
    order = [i for i in np.lexsort((ids, d)) if i != q][:k]
    return [(int(ids[i]), float(d[i])) for i in order]


def search(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("list", F.lit("clash"))
    out = {}
    for r in ann.search(df, F.col("vec_id") % 10 == 0, **options).collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


def test_recall(spark):
    x = vectors(3000)
    got = search(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    hits = 0
    for q in range(0, 3000, 10):
        want = brute(np.arange(3000), x, q, 10)
        assert [r for r, _, _ in got[q]] == list(range(1, 11))
        hits += len({i for _, i, _ in got[q]} & {i for i, _ in want})
        for _, i, s in got[q]:
            assert s == pytest.approx(np.sqrt(((x[i].astype("f8") - x[q].astype("f8")) ** 2).sum()), abs=1e-12)
    assert hits / 3000 >= 0.9


def other_rows():
    """Rows unlike those of the test tables: (name, vectors), every tenth a query."""
    rng = np.random.default_rng(4)
    apart, between = vectors(3000, 32, clusters=60), vectors(3000, 32, clusters=60)
    apart[::10] = 1.2 * rng.normal(size=(300, 32))
    between[::10] = (between[1::10] + between[rng.permutation(300) * 10 + 2]) / 2
    yield "queries apart from the rest", apart
    yield "queries between the rest", between
    yield "large components", vectors(3000, 32) * np.float32(1e20)
    yield "small components", vectors(3000, 32) * np.float32(1e-25)
    yield "rows of every size", rng.normal(size=(3000, 32)) * np.exp(3 * rng.normal(size=(3000, 1)))
    yield "two places far from zero", vectors(3000, 32) + np.where(rng.random((3000, 1)) < 0.5, 1e5, -1e5)


@pytest.mark.parametrize("name, x", list(other_rows()))
def test_recall_on_other_rows(spark, name, x):
    x = x.astype("f4")
    got = search(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    hits = [len({i for _, i, _ in got[q]} & {i for i, _ in brute(np.arange(3000), x, q, 10)}) for q in range(0, 3000, 10)]
    assert np.mean(hits) >= 9


@pytest.mark.parametrize("dim", [1, 17, 61])
def test_nothing_is_missed_in_a_list(spark, dim):
    """Many entries a list, few of them ranked again by code, tight groups beside wide ones, lengths that sixteen parts don't divide."""
    x = vectors(2000, dim)
    x[::2] = x[0] + 1e-3 * vectors(1000, dim, 1)
    got = search(spark, [(i, v.tolist()) for i, v in enumerate(x)], sample=64, recall=1.0, rerank=12)
    for q in range(0, 2000, 10):
        assert [round(s, 9) for _, _, s in got[q]] == [round(s, 9) for _, s in brute(np.arange(2000), x, q, 10)]


def test_distance_to_the_code():
    x = vectors(500, 17)
    model = ann.fit_index(x, len(x))
    near, codes, err = ann.encode_vectors(x, model)
    said = np.concatenate([b[codes[:, p]] for p, b in enumerate(model["books"])], axis=1)[:, :17] * model["scale"][near][:, None] + model["coarse"][near]
    assert err == pytest.approx(np.sqrt(((x - said) ** 2).sum(axis=1)), rel=1e-6)


def test_copies_and_odd_vectors(spark):
    """A third of all vectors are equal; results are exact where all lists are looked into."""
    x = vectors(300, 8)
    x[::3] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(1000, None), (1010, [0.0] * 8), (1020, [float("nan")] + [1.0] * 7), (1030, [None] + [1.0] * 7), (1040, [1.0]), (None, [1.0] * 8), (1050, [float("inf")] * 8), (1060, [])]
    got = search(spark, rows + odd, recall=1.0, rerank=1000)
    assert set(got) == set(range(0, 300, 10))
    for q in got:
        want = brute(np.arange(300), x, q, 10)
        assert [(i, round(s, 9)) for _, i, s in got[q]] == [(i, round(s, 9)) for i, s in want]


def test_repeated_rows(spark):
    """Rows that repeat a vec_id, with the same vector or another, against brute force over rows."""
    x = vectors(120, 8)
    rows = [(i, tuple(v.tolist())) for i, v in enumerate(x)]
    rows += [rows[10]] + [rows[20]] * 12 + [rows[33]] * 2 + [rows[44]] * 14  # queries twice and 13 times; others 3 and 15 times
    rows += [(i, rows[20][1]) for i in range(201, 204)]  # other ids of a copied query's vector
    rows += [(30, rows[77][1]), (41, rows[50][1]), (41, rows[60][1])]  # an id with two vectors
    df = spark.createDataFrame([(i, list(v)) for i, v in rows], "vec_id long, embedding array<float>")
    want = Counter()
    for q in {r for r in rows if r[0] % 10 == 0}:
        near = sorted((round(float(np.sqrt(((np.array(v) - np.array(q[1])) ** 2).sum())), 9), i) for i, v in rows if (i, v) != q)
        want.update((q[0], n, i, d) for n, (d, i) in enumerate(near[:10], 1))
    got = ann.search(df, F.col("vec_id") % 10 == 0, recall=1.0, rerank=1000).collect()
    assert Counter((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got) == want


def test_few_vectors(spark):
    got = search(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [2.0, 0.0])])
    assert got == {0: [(1, 2, 1.0), (2, 1, 2**0.5)]}
    assert search(spark, [(0, [1.0, 0.0])]) == {}
    assert search(spark, []) == {}


def test_queries_look_into_few_lists():
    """100,000 vectors around 1500 points, and as many on a curved 12-dimensional surface: recall of the lists probed."""
    rng = np.random.default_rng(1)
    around = rng.normal(size=(1500, 32))
    sets = [around[rng.integers(0, 1500, 100_000)] + 0.4 * rng.normal(size=(100_000, 32)), np.tanh(rng.normal(size=(100_000, 12)) @ rng.normal(size=(12, 32)) / 4)]
    for x in sets:
        x = x.astype("f4")
        sample = x[rng.permutation(len(x))[: ann.SAMPLE]]
        model = ann.fit_index(sample, len(x))
        far = ann.reach(sample, model, 10, 0.97, len(x))
        home = ann.nearest(x, model["coarse"])[0]
        found, probed = [], []
        for q in range(0, len(x), 1000):
            d = ((x - x[q]) ** 2).sum(axis=1)
            d[q] = np.inf
            look = ann.list_distances(x[q : q + 1], model["coarse"])[0] <= far
            found.append(look[home[np.argpartition(d, 10)[:10]]].mean())
            probed.append(look.mean())
        assert np.mean(found) >= 0.9 and np.mean(probed) <= 0.2
    assert ann.lists_for(10**8, ann.MOST_SAMPLED) > 4 * 4096


def test_two_levels_of_centroids():
    x = np.random.default_rng(2).normal(size=(9000, 4)).astype("f4")
    many = ann.kmeans(x, ann.FLAT * 3)
    assert 0.9 * ann.FLAT * 3 <= len(many) <= 1.1 * ann.FLAT * 3 and np.isfinite(many).all()
    assert ann.nearest(x, many)[1].mean() < 0.5 * ann.nearest(x, ann.kmeans(x, 64))[1].mean()
