"""Operators 5, 6, 7, 8 and 10 against brute force, and the pipeline."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import licenses, mixing, neardup, quality, sharding


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_mix(corpus):
    df, rows = corpus
    plan = mixing.plan_mix(df)
    taken = sum((mixing.copy_words(F.lit(k), False) for k in range(2)), F.lit(0))
    got = plan.select("doc_id", "size", "source_size", "target", taken.alias("taken")).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((d, size_of(t)) for d, t, _ in rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size_of(t)
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total, target = 1.5 * sum(sizes.values()), {}
    while True:  # reshare until none is above
        free = [s for s in names if s not in target]
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        target |= {s: 2.0 * sizes[s] for s in over} if over else share
        if not over:
            break
    by = {sizes[s]: (target[s], s) for s in names}
    assert len(by) == len(names)
    assert all(r.target == pytest.approx(by[r.source_size][0]) and 0 <= r.taken <= 2 * r["size"] for r in got)
    for s in names:
        assert sum(r.taken for r in got if r.source_size == sizes[s]) == pytest.approx(target[s], abs=1)


def test_mix_order_and_copies(corpus):
    df, rows = corpus
    a = mixing.mix(df, keep=["text"], whole=True).collect()
    assert a == mixing.mix(df, keep=["text"], whole=True).collect()
    assert [r.position for r in a] == sorted(r.position for r in a) and all(0 <= r.position <= 1 for r in a)
    assert all(r.words == size_of(r.text) for r in a)


@pytest.mark.parametrize("schedule", mixing.CURRICULUM + (((0.0, 0.0), (0.3, 2.0), (1.0, 0.5)),))
def test_inverse_of_the_integral(spark, schedule):
    def spent(t):
        out = 0.0
        for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
            u = min(max(t - t0, 0.0), t1 - t0)
            out += w0 * u + (w1 - w0) / (t1 - t0) * u * u / 2
        return out

    df = spark.range(101).select((F.col("id") / 100).alias("x"))
    for r in df.select("x", mixing.invert([schedule], F.lit(0), F.col("x")).alias("t")).collect():
        assert spent(r.t) == pytest.approx(r.x * mixing.integral(schedule), abs=1e-9)


def test_mix_of_rows_without_ids(spark, clash):
    """Rows without a doc_id, and of one doc_id, fill buckets beyond their measure."""
    n = 40_000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, 7).otherwise(F.col("id")).alias("doc_id"), F.repeat(F.lit("w "), (1 + F.col("id") % 5).cast("int")).alias("text"), F.when(F.col("id") % 4 == 0, "a").alias("source"))
    plan = mixing.plan_mix(clash(df))
    taken = sum((mixing.copy_words(F.lit(k), False) for k in range(2)), F.lit(0))
    got = plan.select("source_size", "target", "size", "before", "goal", taken.alias("taken"), "bucket", "part").collect()
    assert len(got) == n and max(Counter((r.source_size, r.bucket, r.part) for r in got).values()) < 3 * mixing.BUCKET_ROWS
    for size in {r.source_size for r in got}:
        own = sorted((r for r in got if r.source_size == size), key=lambda r: r.before)
        at = 0
        for r in own:  # end to end without a gap
            assert r.before == at
            at += r["size"]
        assert at == size and sum(r.taken for r in own) == pytest.approx(own[0].target, abs=1)
    kept = mixing.mix(df, keep=["text"]).collect()
    assert sum(r.words for r in kept) == pytest.approx(1.5 * sum(1 + k % 5 for k in range(n)), rel=1e-3)


def test_mix_empty(empty):
    assert mixing.plan_mix(empty).count() == 0 and mixing.mix(empty).count() == 0


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_components(rows, k, num):
    sets = [shingles(t, k) for _, t, _ in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= num * (len(sets[i]) + len(sets[j]) - both):
                top[find(i)] = find(j)
    out = []
    for i, (d, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None] if sets[i] else [d]
        smallest = min((x for x in ids if x is not None), default=None)
        out.append((d, len(sets[i]), smallest, d == smallest))
    return Counter(out)


@pytest.mark.parametrize(("k", "num"), [(3, 85), (5, 80)])
def test_near_duplicates(corpus, k, num):
    df, rows = corpus
    got = neardup.near_duplicates(df, shingle=k, num=num)
    assert Counter(map(tuple, got.collect())) == brute_components(rows, k, num)


def test_near_duplicate_chains(spark):
    """Families whose members link to some and not to others, far beyond one hub's reach."""
    rnd = random.Random(3)
    rows = []
    for fam in range(3):
        w = [f"w{fam}_{i}" for i in range(60)]
        for k in range(60):
            rows.append((1000 * fam + k, " ".join(w), "s"))
            w = [x if rnd.random() > 0.015 else f"e{fam}_{k}_{i}" for i, x in enumerate(w)]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    got = Counter(map(tuple, neardup.near_duplicates(df, shingle=3, num=85).collect()))
    assert got == brute_components(rows, 3, 85)


def test_every_pair_within_the_distance_shares_a_key():
    rnd = random.Random(4)
    bound = neardup.distance_bound(85, 100, 64)
    plan = neardup.chunk_plan(64, bound)
    assert {p for c in plan for p in c} == set(range(64))
    for _ in range(2000):
        wrong = set(rnd.sample(range(64), bound))
        assert any(not wrong & set(c) for c in plan)


def test_near_duplicates_in_parts_and_blocks(spark, clash):
    """A family near and under the threshold, whose keys are dealt in many parts and whose documents in many blocks; half
    of the rows have no doc_id, and some of those one text."""
    rnd = random.Random(8)
    rows = []
    for fam, (size, rate) in enumerate(((150, 0.02), (120, 0.035), (40, 0.01))):
        base = [f"w{fam}_{i}" for i in range(80)]
        for k in range(size):
            rows.append((1000 * fam + k if k % 2 else None, " ".join(x if rnd.random() > rate else f"e{fam}_{k}_{i}" for i, x in enumerate(base)), "s"))
    rows += [(None, "one text of rows without an id", "s")] * 60 + [(7, "one row of many", "s")] * 30 + [(None, None, "s"), (5001, "word " * 40_000, "s")]
    rnd.shuffle(rows)
    df = clash(spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string"))
    want = brute_components(rows, 3, 85)
    for options in ({"meetings": 1, "part_rows": 7, "block_nodes": 5}, {}):
        assert Counter(map(tuple, neardup.near_duplicates(df, shingle=3, num=85, **options).collect())) == want


def test_near_duplicates_of_unlike_texts_with_a_common_passage(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(k, passage + " " + " ".join(f"own{k}_{i}" for i in range(70)), "s") for k in range(300)] + [(k, f"copy {k}" * 3, "s") for k in range(300, 310)]
    df = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    assert Counter(map(tuple, neardup.near_duplicates(df, part_rows=64).collect())) == brute_components(rows, 5, 80)


def test_components(spark):
    """Paths, stars and random trees, against a plain walk."""
    from tessera.llm.components import components

    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(100)] + [(200, 200 + i) for i in range(1, 50)] + [(300 + i, 300 + rnd.randrange(i)) for i in range(1, 200)] + [(600, 600), (700, 701), (701, 700)]
    top = {}
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    for start in sorted(near):
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in top:
                top[x] = start
                todo += near[x]
    del top[600]  # an edge to itself links nothing
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.comp for r in got.collect()} == top


def test_keep_one_of_each_group(spark, corpus):
    df, rows = corpus
    left = neardup.keep(df).collect()
    ids = [r.doc_id for r in left if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and set(left[0].asDict()) == set(df.columns)
    want = {d for (d, _, _, kept) in brute_components(rows, 5, 80) if kept and d is not None}
    assert set(ids) == want and sum(r.doc_id is None for r in left) == 2


def test_keep_goes_by_rows(spark):
    """Rows that share a doc_id, or have none, go or stay by their own texts."""
    texts = {c: " ".join(f"{c}{i}" for i in range(60)) for c in "abcdefg"}
    rows = [(1, texts["a"]), (2, texts["a"] + " near"), (2, texts["b"]), (2, texts["c"]), (3, texts["c"] + " near"), (2, texts["d"]), (2, texts["d"])]
    rows += [(None, texts["e"]), (None, texts["e"] + " near"), (None, texts["f"]), (9, texts["f"]), (5, None), (5, None), (4, texts["g"]), (4, texts["g"] + " near")]
    left = Counter(map(tuple, neardup.keep(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()))
    want = Counter([(1, texts["a"]), (2, texts["b"]), (2, texts["c"]), (2, texts["d"]), (9, texts["f"]), (5, None), (5, None)])
    assert all(left.pop(r) == n for r, n in want.items())
    assert sorted((str(d), t[:1], n) for (d, t), n in left.items()) == [("4", "g", 1), ("None", "e", 1)]  # either of two near copies


def test_near_duplicates_empty(empty):
    assert neardup.near_duplicates(empty).count() == 0 and neardup.keep(empty).count() == 0


def test_licenses(spark, corpus):
    df, rows = corpus
    text = licenses.TEMPLATES[0][1]
    more = [(900, "Under the MIT License; under the mit\nlicense CC-BY-NC cc by nc"), (901, "x " * 30 + text.upper() + " y"), (902, "Permission is hereby granted, free of charge")]
    more += [(903, licenses.TEMPLATES[1][1].replace("obtain", "get a")), (904, "ünder the mit license")]
    df = df.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = licenses.scan_licenses(df).collect()
    assert len(got) == len(rows) + len(more)
    texts = defaultdict(list)
    for d, t in [(d, t) for d, t, _ in rows] + more:
        texts[d].append(t)
    for r in got:
        assert any(_base(t) == (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for t in texts[r.doc_id]), r
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    by = {r.doc_id: r for r in got}
    assert by[900].labels == "cc-by-nc,mit" and by[901].labels == "mit" and by[901].score == 1 and by[901].n_base == 0
    assert by[902].labels == "" and by[903].labels == "apache-2" and by[904].labels == ""
    assert by[200].n_words == 0 and by[200].score == 0 and by[200].first_word is None


def _base(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    at = [(i, label) for phrase, label in licenses.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_texts_of_many_licenses(spark):
    """No number of templates in one text hides one of them."""
    some = [[k for k, (name, _, _) in enumerate(licenses.TEMPLATES) if name in ("mit", "apache-2", "bsd", "gpl-3", "cc-by")], list(range(8)), list(range(8, 16)), list(range(16))]
    df = spark.createDataFrame([(d, " zzz yyy ".join(licenses.TEMPLATES[k][1] for k in ks)) for d, ks in enumerate([*some, some[-1][::-1]])], "doc_id long, text string")
    got = {r.doc_id: set(r.labels.split(",")) for r in licenses.scan_licenses(df).collect()}
    for d, ks in enumerate([*some, some[-1]]):
        assert got[d] >= {licenses.TEMPLATES[k][0] for k in ks}


def test_licenses_match_sql(spark, clash):
    """Templates with words taken out, put in and changed, many in a text: the whole result against SQL."""
    import duckdb

    rnd = random.Random(1)
    rows = [(1000, None), (1001, ""), (1002, "Under the MIT License. cc by nc, CC-BY-NC"), (None, "under the mit license"), (7, "x " * 30_000 + licenses.TEMPLATES[3][1])]
    for k in range(200):
        parts = []
        for _ in range(rnd.randint(0, 3)):
            w = rnd.choice(licenses.TEMPLATES)[1].split()
            for _ in range(rnd.choice([0, 1, 3, 8, 30])):
                j = rnd.randrange(len(w))
                w[j : j + 1] = rnd.choice([["zz"], ["zz", w[j]], []]) or (["zz"] if len(w) == 1 else [])
            parts += w + ["pad"] * rnd.randint(0, 3)
        rows.append((k, " ".join(parts)))
    docs = clash(spark.createDataFrame(rows, "doc_id long, text string"))
    got = Counter(map(tuple, licenses.scan_licenses(docs).collect()))
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert got == Counter(con.sql(licenses.OP8_SQL).fetchall())
    assert len({r[7] for r in got}) > 2


def test_many_licenses_in_one_text_stay_quick(spark):
    text = " ".join(t for _, t, _ in licenses.TEMPLATES) + " "
    row = licenses.scan_licenses(spark.createDataFrame([(1, text * 300)], "doc_id long, text string")).first()
    assert row.labels.count(",") == 15 and row.n_base == 300


def test_licenses_empty(empty):
    assert licenses.scan_licenses(empty).count() == 0


def test_ring(spark, corpus):
    df, rows = corpus
    got = sharding.assign_shards(df, 4).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_ring_is_balanced_and_moves_little(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text that many share").otherwise(F.repeat(F.md5(F.col("id").cast("string")), F.pmod(F.xxhash64("id"), F.lit(9)).cast("int"))).alias("text"))
    a, b = ({r.doc_id: r for r in sharding.assign_shards(df, n).collect()} for n in (16, 17))
    for got, n in ((a, 16), (b, 17)):
        load = Counter()
        for r in got.values():
            load[r.shard] += r["size"]
        mean = sum(load.values()) / n
        assert max(load.values()) <= 1.01 * mean and min(load.values()) >= 0.97 * mean
    moved = sum(a[k].shard != b[k].shard for k in a) / len(a)
    assert moved < 0.25  # the new shard's share is 0.06


def test_ring_against_a_walk_by_bytes(spark, clash):
    """Every byte goes clockwise by itself to the first virtual node whose shard has room; a document follows its middle."""
    rnd = random.Random(9)
    texts = [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 12))) for _ in range(4000)] + ["hot"] * 900 + ["", None]
    rows = [(k if k % 5 else None, t) for k, t in enumerate(texts)]
    shards, bits = 5, 6
    df = clash(spark.createDataFrame(rows, "doc_id long, text string"))
    got = Counter((r.doc_id, r["size"], r.text_crc32, r.shard) for r in sharding.assign_shards(df, shards, cell_bits=bits, vnodes=4).collect())
    points = spark.createDataFrame([(t or "",) for _, t in rows], "t string").select(F.xxhash64("t")).collect()
    docs = sorted((p[0] % (1 << 64) >> (64 - bits), p[0], d is not None, d or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for p, (d, t) in zip(points, rows, strict=True))
    nodes = sharding.ring(spark, shards, 4, bits)
    total = sum(d[4] for d in docs)
    room = [max(-(-total // shards), int(total / shards * 1.001))] * shards
    limit = total / shards / sharding.LARGE
    assert all(d[4] <= limit for d in docs)  # none walks alone here
    want = Counter()
    for cell, _, has, doc, size, crc in docs:
        owners = []
        for _ in range(size):
            k = next(k for k in range(len(nodes)) if nodes[k][0] >= cell) if any(c >= cell for c, _ in nodes) else 0
            while not room[nodes[k % len(nodes)][1]]:
                k += 1
            owners.append(nodes[k % len(nodes)][1])
            room[owners[-1]] -= 1
        want[(doc if has else None, size, crc, owners[size // 2])] += 1
    assert got == want


def test_ring_with_rows_without_ids(spark):
    df = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one text").alias("text"))
    got = sharding.assign_shards(df, 16).collect()
    load = Counter(r.shard for r in got)
    assert len(got) == 20_000 and max(load.values()) <= 1260 and {(r.shard, r.slot) for r in got} == {(s, k) for s in range(16) for k in range(load[s])}


def test_walk_goes_clockwise():
    nodes = [(0, 0), (5, 1), (9, 0)]
    spans, alone = sharding.walk({1: 10, 6: 10}, [], nodes, 2, 0.0)
    assert [(x["cell"], x["lo"], x["shard"]) for x in spans] == [(1, 0, 1), (6, 0, 0)] and not alone


def test_ring_empty(empty):
    assert sharding.assign_shards(empty, 16).count() == 0


def test_classifier(spark):
    rnd = random.Random(6)
    good = ["river", "stone", "walks", "under", "light", "quiet", "north", "seven"]
    rows, labels = [], []
    for k in range(400):
        y = k % 2
        words = [rnd.choice(good) for _ in range(30)]
        rows.append((k, " ".join(words) if y else " ".join(w.upper() + "!!" for w in words)))
        labels.append((k, y, 0))
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (None, "river stone"), (5, rows[5][1])], "doc_id long, text string").withColumn("score", F.lit("clash"))
    marks = spark.createDataFrame([*labels, (7777, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, marks, sample=60)
    got = [(r.doc_id, r.score) for r in quality.score(docs, model).collect()]
    assert len(got) == 404 and all(0 <= s <= 1 for _, s in got)
    held = [(d, s) for d, s in got if d is not None and d < 400 and zlib.crc32(str(d).encode()) % 3 == 1]
    assert len(held) > 100 and all((s >= 0.5) == bool(d % 2) for d, s in held)
    assert dict(got)[900] == dict(got)[901] == 0.5
    kept = {r.doc_id for r in quality.keep(docs, model).collect()}
    assert 900 in kept and 1 in kept and 2 not in kept
    none = quality.fit(docs, marks.where("quality = 1"))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}


def test_scores_against_the_model_written_out(spark):
    """The score by way of words kept is that of a document's averaged features."""
    import numpy as np

    rnd = random.Random(11)
    words = ["river", "stone", "Été", "漢字", "x", "don't", "aaa", "<b>", "42"]
    rows = [(k, " ".join(rnd.choice(words) + rnd.choice(["", "s", "!"]) for _ in range(rnd.choice([1, 2, 30, 400])))) for k in range(60)] + [(90, "na na na"), (91, None), (92, " \n"), (93, "long " * 200_000)]
    odds = np.random.default_rng(1).normal(size=quality.BUCKETS).astype("f4")
    for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string"), odds.tobytes()).collect():
        ids, share = quality.document_buckets(dict(rows)[r.doc_id])
        assert r.score == pytest.approx(1 / (1 + np.exp(-float(share @ odds[ids].astype("f8")))) if len(ids) else 0.5, abs=1e-9)


def test_classifier_with_a_hot_document(spark):
    """Rows and labels that repeat a doc_id don't crowd others out of training."""
    ids = [k for k in range(60) if zlib.crc32(str(k).encode()) % 3 != 1][:16]
    one = [(k, "river stone walks" if n % 2 else "LOUD!! LOUDER!!") for n, k in enumerate(ids)]
    docs = spark.createDataFrame([one[0]] * 2000 + one, "doc_id long, text string")
    marks = spark.createDataFrame([(ids[0], 0)] * 50 + [(k, n % 2) for n, k in enumerate(ids)], "doc_id long, quality int")
    model = quality.fit(docs, marks, sample=10)
    assert model == quality.fit(spark.createDataFrame(one, docs.schema), marks.distinct(), sample=10)
    assert any(model)


def test_classifier_empty(spark, empty):
    marks = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.score(empty, quality.fit(empty, marks)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = before = spark.read.parquet(f"{d}/documents.parquet")
    counts = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, d)
        if k < 3:
            assert docs.dtypes == before.dtypes
            docs = docs.cache()
        counts.append(docs.count())
        if k == 0:  # labelled clean documents stay
            marks = spark.read.parquet(f"{d}/labels.parquet")
            assert before.join(marks.where("quality = 1"), "doc_id").join(docs, "doc_id", "left_anti").count() == 0
    assert counts[0] < before.count() and counts[1] <= counts[0]
    assert docs.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048


def test_pipeline_stages_against_brute_force(spark, clash, corpus, tmp_path):
    """Every stage on odd rows: nulls, no words, copies, repeated rows, columns whose names clash."""
    import corpus_pipeline

    df, rows = corpus
    marks = [(k, 1 if k % 2 else 0) for k in range(0, 60)]
    spark.createDataFrame(marks, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    model = quality.fit(df, spark.createDataFrame(marks, "doc_id long, quality int"))
    stages = dict(corpus_pipeline.STAGES)

    def run(name, docs):
        out = stages[name](spark, docs, str(tmp_path))
        return out, Counter((r.doc_id, r.text, r.source) for r in out.select("doc_id", "text", "source").collect())

    import numpy as np

    odds = np.frombuffer(model, "f4").astype("f8")

    def rejected(text):
        ids, share = quality.document_buckets(text)
        return len(ids) and float(share @ odds[ids]) < -1e-9

    out, got = run("quality classifier", df)
    assert out.columns == df.columns and got == Counter(r for r in rows if not rejected(r[1]))
    out, got = run("near duplicates", df)
    assert out.columns == df.columns
    kept = {d for (d, n, c, k) in brute_components(rows, 5, 80) if d is not None and (k or not n)}
    assert {d for d, _, _ in got if d is not None} == kept and all(n == 1 or not (t or "").split() for (_, t, _), n in got.items())
    out, got = run("mix", df)
    assert out.columns == df.columns
    whole = Counter(rows)
    assert all(n <= 2 * whole[r] for r, n in got.items()) and all(size_of(t) for _, t, _ in got)
    plan = {(r.source, r.target) for r in mixing.plan_mix(df).select("source_size", "target", F.col("source_size").alias("source")).collect()}
    for size, target in plan:
        names = [s for s in {s for _, _, s in rows} if sum(size_of(t) for _, t, x in rows if x == s) == size]
        words = sum(n * size_of(t) for (_, t, s), n in got.items() if s in names)
        assert abs(words - target) <= max(size_of(t) for _, t, s in rows if s in names)
    out, _ = run("mix", df.limit(0))
    assert out.count() == 0 and out.columns == df.columns
    packed = stages["packing"](spark, df, str(tmp_path)).collect()
    spans = defaultdict(list)
    for r in packed:
        spans[r.sequence_id].append((r.offset, r.length))
    for own in spans.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert Counter(r.doc_id for r in packed if r.start == 0) == Counter(d for d, _, _ in rows)
