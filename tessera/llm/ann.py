"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Equal vectors are one entry with an id of its own; its rows of one vec_id are a class, with their number. An entry keeps
the classes of its smallest vec_ids: as many as can stand in a result. So a vector copied a million times is searched
for once and found once. Coarse centroids and codebooks are fitted on a
bounded sample (`sample` entries); every entry is indexed. A query looks into the lists of its nearest centroids, as far as
it takes to find the wanted part of neighbours, measured by the query's own surroundings: in the sample, and for at most
MEASURED of the queries themselves by brute force over all entries, as queries may lie where few other rows do. Queries
of dense and of sparse surroundings are measured apart. An asymmetric distance table ranks a block of a list by code, and
the best of the block are ranked again by exact distances, in double precision, to the original vectors. An entry's
distance to its code is kept: whatever it can't rule out is compared exactly too, so within the lists that a query looks
into nothing is missed. Lists and their queries are dealt in blocks of bounded rows.

Nearness is the Euclidean distance, ties go to the smaller vec_id.

Defined cases. Vectors that are null, zero, hold null or non-finite components, or are of another length than most (of
equally common lengths, the smaller), take no part, neither as queries nor as results; so do rows without a vec_id.
Rows that repeat a vec_id are rows of their own: each can stand in a result, and with other vectors they are other
queries, each ranked for itself. Rows alike in vec_id and vector ask once, and none of them is in their own result, so
that copies of a query don't take the places of its neighbours. A query without other rows has no result rows, one with fewer than k
has them all (lists that hold fewer than k + 1 entries are searched on until there are enough). An empty table gives
no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, prepare, save

#: Entries that centroids and codebooks are fitted on: SAMPLE, or more for many lists, up to MOST_SAMPLED.
SAMPLE = 20_000
MOST_SAMPLED = 320_000
CODEBOOK_ROWS = 20_000
#: Centroids beyond which k-means goes in two levels.
FLAT = 512
BLOCK_ROWS = 4096
BLOCK_QUERIES = 512
RERANK = 100
#: Queries whose neighbours are found by brute force, at most, and how many of them share a reach.
MEASURED = 256
ALIKE = 32


def usable(v: Column) -> Column:
    """Vectors that take part."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def kmeans(x, k: int, rounds: int = 12, seed: int = 3):
    """Centroids of x, by Lloyd's rounds from distinct rows; an empty cluster moves to the worst-placed row. For many
    centroids, rows are first clustered by the root of k, and then each cluster by itself."""
    import numpy as np

    rng = np.random.default_rng(seed)
    if k > FLAT:
        near, _ = nearest(x, kmeans(x, round(math.sqrt(k)), rounds, seed))
        groups = [np.flatnonzero(near == j) for j in np.unique(near)]
        share = [max(1, round(k * len(g) / len(x))) for g in groups]
        return np.concatenate([kmeans(x[g], min(n, len(g), FLAT), rounds, seed) for g, n in zip(groups, share, strict=True)])
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near, dist = nearest(x, c)
        order = np.argsort(near, kind="stable")
        some, first = np.unique(near[order], return_index=True)
        n = np.bincount(near, minlength=len(c))
        c[some] = np.add.reduceat(x[order], first, axis=0) / n[some, None]
        for j, far in zip(np.flatnonzero(n == 0), np.argsort(-dist), strict=False):
            c[j] = x[far]
    return c


def nearest(x, c):
    """(place in c, squared distance) of the row of c nearest to each row of x: in double precision and from the middle of
    c, as single precision ends at 1e19 and loses what lies far from zero."""
    import numpy as np

    near, dist = np.empty(len(x), "i8"), np.empty(len(x))
    c = np.asarray(c, "f8")
    middle = c.mean(axis=0)
    c = c - middle
    half = (c * c).sum(axis=1)
    for at in range(0, len(x), 4096):
        v = np.asarray(x[at : at + 4096], "f8") - middle
        d = half - 2 * (v @ c.T)
        near[at : at + 4096] = d.argmin(axis=1)
        dist[at : at + 4096] = np.maximum(d.min(axis=1) + (v * v).sum(axis=1), 0)
    return near, dist


def lists_for(n: int, sample: int) -> int:
    """Lists for n entries: twice the root, so that a query that looks into a fixed number of them sees a share of the
    entries that falls with the root of n; and eight sampled entries a list at least."""
    return max(1, min(round(2 * math.sqrt(n)), sample // 8))


def fit_index(sample, n: int, parts: int = 16) -> dict:
    """Coarse centroids, the size of residuals in each list, and codebooks for residuals of size 1: lists may differ in
    density by any factor. A length that `parts` doesn't divide is filled up with zeros."""
    import numpy as np

    x = np.asarray(sample, "f8")
    coarse = kmeans(x, lists_for(n, len(x)))
    near, dist = nearest(x, coarse)
    scale = np.sqrt(np.bincount(near, dist, len(coarse)) / np.maximum(np.bincount(near, minlength=len(coarse)), 1))
    scale[scale == 0] = np.median(scale[scale > 0]) if scale.any() else 1
    some = np.random.default_rng(5).permutation(len(x))[:CODEBOOK_ROWS]
    width = math.ceil(x.shape[1] / parts)
    rest = in_parts((x[some] - coarse[near[some]]) / scale[near[some], None], width)
    books = [kmeans(rest[:, p : p + width], min(256, len(rest)), 6) for p in range(0, rest.shape[1], width)]
    return {"coarse": coarse, "scale": scale, "books": books, "width": width}


def in_parts(x, width: int):
    """Rows filled up with zeros to a multiple of `width`."""
    import numpy as np

    return np.pad(x, ((0, 0), (0, -x.shape[1] % width)))


def surroundings(x, coarse):
    """(squared distances of rows to all centroids, mean of the nearest few)."""
    import numpy as np

    coarse = np.asarray(coarse, "f8")
    middle = coarse.mean(axis=0)
    x, coarse = np.asarray(x, "f8") - middle, coarse - middle
    d = np.maximum((x * x).sum(axis=1)[:, None] + (coarse * coarse).sum(axis=1) - 2 * (x @ coarse.T), 0)
    few = min(4, d.shape[1])
    return d, np.partition(d, few - 1, axis=1)[:, :few].mean(axis=1)


def list_distances(x, coarse):
    """Squared distances of rows to all centroids, over that to the nearest few: what is near by the measure of the row's
    own surroundings, be they dense or sparse."""
    import numpy as np

    d, few = surroundings(x, coarse)
    return d / np.maximum(few, np.finfo("f8").tiny)[:, None]


def reach(sample, model: dict, k: int, target: float, n: int, queries: int = 400) -> float:
    """How far a query looks, as list_distances measure, to find `target` of its k nearest neighbours among n: found by
    brute force in the sample for queries drawn from it. The k nearest of n are as near as the first of k * sample / n
    there, or nearer."""
    import numpy as np

    x = np.asarray(sample, "f8")
    if len(x) < 2:
        return math.inf
    k = math.ceil(k * len(x) / max(n, len(x)))
    home = nearest(x, model["coarse"])[0]
    far = []
    for q in range(0, len(x), max(1, len(x) // queries)):
        d = np.concatenate([((x[at : at + 16384] - x[q]) ** 2).sum(axis=1) for at in range(0, len(x), 16384)])
        d[q] = np.inf
        near = np.argpartition(d, min(k, len(x) - 1) - 1)[: min(k, len(x) - 1)]
        far.append(list_distances(x[q : q + 1], model["coarse"])[0][home[near]])
    return float(np.quantile(np.concatenate(far), target))


def reaches(asked, homes: list, coarse, target: float, least: float):
    """(bounds, reaches) by the density of a query's surroundings: reaches[j] is how far queries look that lie between
    bounds[j - 1] and bounds[j], `least` or farther. homes: for each of `asked`, the lists its nearest entries are in."""
    import numpy as np

    few = surroundings(asked, coarse)[1]
    groups = np.array_split(np.argsort(few, kind="stable"), max(1, len(asked) // ALIKE))
    far = []
    for g in groups:
        need = [d[homes[q]] for q, d in zip(g, list_distances(asked[g], coarse), strict=True) if len(homes[q])]
        far.append(max([least] + ([float(np.quantile(np.concatenate(need), target, method="higher"))] if need else [])))
    return np.array([few[g[0]] for g in groups[1:]]), np.array(far)


def encode_vectors(x, model: dict):
    """(list, codes, distance to what the codes say) of each row."""
    import numpy as np

    near, _ = nearest(x, model["coarse"])
    scale, w = model["scale"][near], model["width"]
    rest = in_parts((x - model["coarse"][near]) / scale[:, None], w)
    codes = np.stack([nearest(rest[:, p * w : (p + 1) * w], b)[0].astype("u1") for p, b in enumerate(model["books"])], axis=1)
    said = np.concatenate([b[codes[:, p]] for p, b in enumerate(model["books"])], axis=1)
    return near, codes, scale * np.sqrt(((rest - said) ** 2).sum(axis=1))


def _rows(col):
    """An Arrow list column of equal lengths as a matrix."""
    import numpy as np

    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), "f8").reshape(len(col), -1) if len(col) else np.empty((0, 0))


def _index(batches: Iterator, model) -> Iterator:
    import pyarrow as pa

    for b in batches:
        x = _rows(b.column(1))
        if not len(x):
            continue
        near, codes, err = encode_vectors(x, model.value)
        yield pa.record_batch(
            [b.column(0), b.column(1), pa.array(near.astype("i4")), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(err), b.column(2)], ["entry", "vec", "list", "code", "err", "lead"]
        )


def _measure(batches: Iterator, ids, asked, k: int) -> Iterator:
    """The k nearest entries of the partition for each of `asked`, by brute force: (place in asked, list, distance)."""
    import numpy as np
    import pyarrow as pa

    middle = asked.mean(axis=0)
    v = asked - middle
    size = (v * v).sum(axis=1)[:, None]
    dist, home = np.full((len(v), k), np.inf), np.zeros((len(v), k), "i4")
    for b in batches:
        y = _rows(b.column(1))
        if not len(y):
            continue
        y = y - middle
        about = size + (y * y).sum(axis=1) - 2 * (v @ y.T)
        about[ids[:, None] == b.column(0).to_numpy()] = np.inf
        best = np.argpartition(about, 2 * k, axis=1)[:, : 2 * k] if len(y) > 2 * k else np.broadcast_to(np.arange(len(y)), about.shape)
        exact = np.where(np.isinf(np.take_along_axis(about, best, 1)), np.inf, ((y[best] - v[:, None, :]) ** 2).sum(axis=2))
        dist, home = np.concatenate([dist, exact], axis=1), np.concatenate([home, b.column(2).to_numpy()[best]], axis=1)
        best = np.argpartition(dist, k - 1, axis=1)[:, :k]
        dist, home = np.take_along_axis(dist, best, 1), np.take_along_axis(home, best, 1)
    q, at = np.nonzero(np.isfinite(dist))
    yield pa.record_batch([pa.array(q.astype("i4")), pa.array(home[q, at]), pa.array(dist[q, at])], ["q", "list", "dist"])


def _probe(batches: Iterator, model, bounds, far, least: int, sizes: list[int]) -> Iterator:
    """Queries with the lists to look into: those within reach, and the nearest that together have enough entries."""
    import numpy as np
    import pyarrow as pa

    sizes = np.array(sizes)
    for b in batches:
        x = _rows(b.column(1))
        if not len(x):
            continue
        for at in range(0, len(x), 256):
            d = list_distances(x[at : at + 256], model.value["coarse"])
            look = far[np.searchsorted(bounds, surroundings(x[at : at + 256], model.value["coarse"])[1], side="right")]
            order = np.argsort(d, axis=1, kind="stable")
            held = np.cumsum(sizes[order], axis=1)
            need = np.maximum((d <= look[:, None]).sum(axis=1), (held < least).sum(axis=1) + 1)
            lists = [o[:n].tolist() for o, n in zip(order, need, strict=True)]
            yield pa.record_batch([b.column(0).slice(at, 256), b.column(1).slice(at, 256), pa.array(lists, pa.list_(pa.int32()))], ["entry", "vec", "lists"])


def _left_open(rest, y, size, least, best, exact, keep: int) -> list:
    """For each query the entries beside `best` that can be among its `keep` nearest. rest, y: queries and entries from the
    centroid; least: how near an entry is at the nearest, its distance by code less its distance to the code."""
    import numpy as np

    length = np.sqrt((rest * rest).sum(axis=1))
    # what rounding may add to any of these distances, and more
    bound = (np.partition(exact, keep - 1, axis=1)[:, keep - 1] + 1e-6 * (length + np.sqrt(size.max())))[:, None]
    able = least <= bound
    np.put_along_axis(able, best, False, axis=1)
    some = np.flatnonzero(able.any(axis=0))
    about = np.sqrt(np.maximum((length**2)[:, None] + size[some] - 2 * (rest @ y[some].T), 0))
    able = able[:, some] & (about <= bound)
    return [some[a] for a in able]


def _search(left, right, model, keep: int, rerank: int):
    """One block of a list (left) and one block of its queries (right): the `keep` exact nearest entries for each, of equally
    near ones those of the smaller `lead` (an entry's smallest vec_id)."""
    import numpy as np
    import pyarrow as pa

    out: list[list] = [[], [], [], []]
    if left.num_rows and right.num_rows:
        m = model.value
        x, asked = _rows(left.column("vec").combine_chunks()), _rows(right.column("vec").combine_chunks())
        ids, lead, who = left.column("entry").to_numpy(), left.column("lead").to_numpy(), right.column("entry").to_numpy()
        codes = np.frombuffer(b"".join(left.column("code").to_pylist()), "u1").reshape(len(ids), -1)
        err = left.column("err").to_numpy()
        home, w, rerank = left.column("list")[0].as_py(), m["width"], max(rerank, keep)
        centre, scale = m["coarse"][home], m["scale"][home]
        y = x - centre
        size = (y * y).sum(axis=1)
        for at in range(0, len(asked), 32):
            v = asked[at : at + 32]
            best = np.broadcast_to(np.arange(len(ids)), (len(v), len(ids)))
            more = None
            if len(ids) > rerank:
                rest, about = v - centre, np.zeros((len(v), len(ids)))
                scaled = in_parts(rest / scale, w)
                for p, book in enumerate(m["books"]):
                    part = scaled[:, p * w : (p + 1) * w]
                    about += ((part * part).sum(axis=1)[:, None] + (book * book).sum(axis=1) - 2 * (part @ book.T))[:, codes[:, p]]
                about = scale * np.sqrt(np.maximum(about, 0))
                best = np.argpartition(about, rerank, axis=1)[:, :rerank]
            exact = np.sqrt(((x[best] - v[:, None, :]) ** 2).sum(axis=2))
            if len(ids) > rerank:
                more = _left_open(rest, y, size, about - err, best, exact, keep)
            for k in range(len(v)):
                some, near = best[k], exact[k]
                if more and len(more[k]):
                    some = np.concatenate([some, more[k]])
                    near = np.concatenate([near, np.sqrt(((x[more[k]] - v[k]) ** 2).sum(axis=1))])
                top = np.lexsort((ids[some], lead[some], near))[:keep]
                out[0].append(np.full(len(top), who[at + k]))
                out[1].append(ids[some][top])
                out[2].append(lead[some][top])
                out[3].append(near[top])
    cols = [pa.array(np.concatenate(c), t) if c else pa.array([], t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)]
    return pa.table(cols, names=["q", "entry", "lead", "score"])


def _calibrate(index: DataFrame, asked: DataFrame, drawn, fitted: dict, k: int, recall: float, n: int):
    """How far queries look (reaches)."""
    import numpy as np

    # another order than the sample's: centroids lie better for what they were fitted on
    some = asked.orderBy(F.xxhash64(F.lit("measured"), "lead"), "lead", "same").limit(MEASURED).select("entry", "vec").toArrow()
    if recall >= 1 or not some.num_rows:
        return np.empty(0), np.array([math.inf])
    ids, v = some.column(0).to_numpy(), _rows(some.column(1).combine_chunks())
    near = index.select("entry", "vec", "list").mapInArrow(lambda it: _measure(it, ids, v, k), "q int, list int, dist double")
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("dist", "list"))).where(F.col("r") <= k)
    homes: list[list[int]] = [[] for _ in v]
    for r in near.collect():  # k rows a measured query
        homes[r.q].append(r.list)
    return reaches(v, homes, fitted["coarse"], recall, reach(drawn, fitted, k, recall, n))


def search(vectors: DataFrame, is_query: Column, k: int = 10, sample: int | None = None, recall: float = 0.97, rerank: int = RERANK, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest rows found for each row where is_query holds (a condition on
    vec_id), the row itself and its copies left out.

    recall: queries look as far as finds this part of the neighbours of those measured; 1 looks into all lists, and is
    exact. sample: the most entries to fit on."""
    spark = vectors.sparkSession
    prepare(spark)
    src = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec")).where(F.col("vec_id").isNotNull() & usable(F.col("vec")))
    common = src.groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    dim, _ = (common.dim, common.n) if common else (0, 0)
    src = src.where(F.size("vec") == dim).withColumn("same", F.md5(F.array_join(F.transform("vec", lambda x: (x + 0.0).cast("string")), ",")))
    rows = save(src, "vectors")
    # equal vectors: the classes of the smallest ids of each, all that k results beside the query's own class can need
    classes = rows.groupBy("same", "vec_id").agg(F.first("vec").alias("vec"), F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("copies"))
    nth = F.row_number().over(Window.partitionBy("same").orderBy("vec_id"))
    members = save(classes.withColumn("nth", nth).where(F.col("nth") <= k + 1).select("same", "vec_id", "copies", "nth", "vec"), "members")
    entries = save(members.where("nth = 1").select(F.monotonically_increasing_id().alias("entry"), F.col("vec_id").alias("lead"), "vec", "same"), "entries")
    n = entries.count()
    queries = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "same").distinct()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    picked = entries.select("vec", F.xxhash64("lead").alias("h"), "lead", "same").orderBy("h", "lead", "same").limit(sample or min(MOST_SAMPLED, max(SAMPLE, round(64 * math.sqrt(n))))).select("vec").toArrow()
    drawn = _rows(picked.column(0).combine_chunks())
    fitted = fit_index(drawn, n)
    model = spark.sparkContext.broadcast(fitted)  # bounded by the sample
    index = save(entries.select("entry", "vec", "lead").mapInArrow(lambda it: _index(it, model), "entry long, vec array<double>, list int, code binary, err double, lead long"), "index")
    sizes = {r.list: r.n for r in index.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a list
    held = [sizes.get(j, 0) for j in range(len(fitted["coarse"]))]
    asked = save(queries.select("same").distinct().join(entries, "same").select("entry", "vec", "lead", "same"), "asked")
    bounds, far = _calibrate(index, asked, drawn, fitted, k, recall, n)
    asked = asked.select("entry", "vec").mapInArrow(lambda it: _probe(it, model, bounds, far, k + 1, held), "entry long, vec array<double>, lists array<int>").select("entry", "vec", F.explode("lists").alias("list"))
    asked = save(asked, "probes")
    blocks = index.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    groups = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("groups"))
    plan = F.broadcast(blocks.join(groups, "list"))  # one row a list
    left = index.join(plan, "list").withColumn("block", F.pmod(F.xxhash64("entry"), F.col("blocks")).cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    right = asked.join(plan, "list").withColumn("group", F.pmod(F.xxhash64("entry"), F.col("groups")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    by = ("list", "block", "group")
    found = left.select(*by, "entry", "lead", "vec", "code", "err").groupBy(*by).cogroup(right.select(*by, "entry", "vec").groupBy(*by)).applyInArrow(
        lambda a, b: _search(a, b, model, k + 1, rerank), "q long, entry long, lead long, score double"
    )
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("score", "lead", "entry"))).where(F.col("r") <= k + 1)
    of_entry = members.select("same", "vec_id", "copies").join(entries.select("same", "entry"), "same").select("entry", "vec_id", "copies")
    near = best.join(of_entry, "entry").select("q", "entry", "vec_id", "copies", "score")
    # k + 1 classes: a query leaves out one of them, its own, and each other has a row at least
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id", "entry"))).where(F.col("r") <= k + 1)
    who = queries.join(entries.select("same", F.col("entry").alias("q")), "same").select("query_id", "q")
    out = who.join(near, "q").where("entry <> q OR vec_id <> query_id")
    before = F.sum("copies").over(Window.partitionBy("query_id", "q").orderBy("r").rowsBetween(Window.unboundedPreceding, -1))
    out = out.withColumn("before", F.coalesce(before, F.lit(0)).cast("int")).where(F.col("before") < k)
    ranks = F.sequence(F.col("before") + 1, F.least(F.col("before") + F.col("copies"), F.lit(k)))
    return out.select("query_id", F.explode(ranks).alias("rank"), "vec_id", "score")


def op3_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of every row whose vec_id is divisible by 100."""
    return search(documents(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
