"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

A signature holds 64 positions of 16 bits. A pair of similarity J differs in about 64(1 - J) positions; the distance
bound r lies five standard deviations above that at the threshold, so a pair above the threshold goes beyond r with a
chance of about one in a million. Pigeonhole: of m = r // 2 + 1 chunks of positions, two signatures within distance r
have one that differs in at most one place. So each chunk is indexed once for each of its positions left out, and
every pair within distance r shares a key. That is a guarantee, not a probability.

Members of a key are compared by signature at once, where the key brings them together, and never listed as pairs. Two
rounds of meeting give every document one partner at most: the nearest within r, in any of its keys, that is of another
component. Partners are confirmed on full shingle sets (64-bit hashes of all shingles), and confirmed links make
components. That leaves few keys whose members are within r and yet of several components. There, at last, everything
is compared: documents go into blocks, pairs of blocks that hold such members get the full sets of both, once, and give
at most as many links as they have members. So no link between components is missed, links inside one need no proof,
and no step lists the pairs of a group. Work in the last step is what the unlinked pairs within r demand.

A key of many members is dealt in parts of 2048, one task's work at a time, and the last step in pairs of parts. Copies
with equal sets are one class from the start.

Defined cases. Null text has no shingles, nor has text without words: such rows link with nothing and are components
of their own. Rows are documents even if they repeat a doc_id. Null doc_ids take part; the component's id is the
smallest that isn't null, and null if all are. An empty table gives no rows. Other columns are ignored, whatever their
names. Very long texts make long sets, which are signed in parts.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, drop, prepare, save, unused
from .components import components

_MIX = 0x9E3779B97F4A7C15
#: Members of a key that one group compares.
PART_ROWS = 2048
#: Documents in a block, and shingles in them, about.
BLOCK_NODES = 256
BLOCK_SHINGLES = 1 << 20
#: Rows that are compared with a group at a time.
STEP = 64
#: Pieces that a block's home or a partner of many is dealt in.
SALTS = 64
_words: dict[bytes, int] = {}


def shingle_set(text: bytes, k: int):
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words than k are one shingle."""
    import numpy as np
    import xxhash

    if len(_words) > 500_000:
        _words.clear()
    words = text.lower().split()  # of bytes: A-Z only, and the six ASCII white spaces
    if not words:
        return np.empty(0, "u8")
    seen = _words
    for w in set(words):
        if w not in seen:
            seen[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(seen.__getitem__, words), "u8", len(words))
    n = min(k, len(words))
    acc = np.full(len(words) - n + 1, n, "u8")
    for j in range(n):
        acc = (acc ^ h[j : len(words) - n + 1 + j]) * np.uint64(_MIX)
        acc ^= acc >> np.uint64(31)
    return np.unique(acc)


def _factors(positions: int):
    import numpy as np

    return np.random.default_rng(20240229).integers(1, 1 << 63, positions, "u8") * np.uint64(2) + np.uint64(1)


def signature(hashes, factors):
    """b-bit MinHash: 16 bits of the smallest value under each multiplier."""
    import numpy as np

    low = np.full(len(factors), np.iinfo("u8").max, "u8")
    for at in range(0, len(hashes), 2048):
        low = np.minimum(low, (factors[:, None] * hashes[None, at : at + 2048]).min(axis=1))
    return (((low ^ (low >> np.uint64(29))) * np.uint64(_MIX)) >> np.uint64(48)).astype("<u2")


def distance_bound(num: int, den: int, positions: int, sigmas: float = 5) -> int:
    j = num / den
    return math.ceil(positions * (1 - j) + sigmas * math.sqrt(positions * j * (1 - j)))


def chunk_plan(positions: int, bound: int, errors: int = 1) -> list[tuple[int, ...]]:
    """The position sets that are keys: each chunk with each choice of `errors` positions left out."""
    m = bound // (errors + 1) + 1
    cuts = [round(k * positions / m) for k in range(m + 1)]
    chunks = [range(a, b) for a, b in itertools.pairwise(cuts)]
    return [tuple(p for p in c if p not in out) for c in chunks for out in itertools.combinations(c, min(errors, len(c) - 1))]


def brief(sig):
    """Four bits of each position, 16 positions to a 64-bit word. Briefs differ in no more positions than signatures do,
    so what they rule out is out."""
    import numpy as np

    low = (np.atleast_2d(sig) & 15).astype("u8").reshape(-1, sig.shape[-1] // 16, 16)
    return (low << (4 * np.arange(16, dtype="u8"))).sum(axis=2, dtype="u8")


def differing(x, y):
    """The number of positions in which briefs differ; the last axis is that of words."""
    import numpy as np

    out = 0
    for w in range(x.shape[-1]):  # a word at a time keeps what is worked on small
        z = x[..., w] ^ y[..., w]
        z |= z >> np.uint64(2)
        z |= z >> np.uint64(1)
        z &= np.uint64(0x1111111111111111)
        out = out + np.bitwise_count(z)
    return out


def _mixed(x):
    import numpy as np

    x = (x.astype("u8") ^ (x.astype("u8") >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _sign(batches: Iterator, k: int, positions: int) -> Iterator:
    import pyarrow as pa
    import xxhash

    factors = _factors(positions)
    for b in batches:
        n, key, sig, short = [], [], [], []
        for t in b.column(1):
            s = shingle_set((t.as_py() or "").encode(), k)
            own = signature(s, factors) if len(s) else None
            n.append(len(s))
            key.append(xxhash.xxh3_128_digest(s.tobytes()))
            sig.append(None if own is None else own.tobytes())
            short.append(None if own is None else brief(own).tobytes())
        cols = [b.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary()), pa.array(short, pa.binary()), b.column(2)]
        yield pa.record_batch(cols, ["doc_id", "n_shingles", "set_key", "sig", "brief", "digest"])


def _keys(batches: Iterator, plan: list[tuple[int, ...]], positions: int) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for b in batches:
        node = b.column(0).to_numpy()
        sig = np.frombuffer(b"".join(b.column(1).to_pylist()), "<u2").reshape(-1, positions).astype("u8")
        out = []
        for i, places in enumerate(plan):
            acc = np.full(len(sig), i + 1, "u8") * np.uint64(0xD6E8FEB86659FD93)
            for p in places:
                acc = (acc ^ sig[:, p]) * np.uint64(_MIX)
                acc ^= acc >> np.uint64(32)
            out.append(acc.view("i8"))
        yield pa.record_batch([pa.array(np.concatenate(out)), pa.array(np.tile(node, len(plan)))], ["key", "node"])


def _shared(batches: Iterator, part_rows: int) -> Iterator:
    """Of rows (key, node) in order of key: those of keys with more than one, and the part of the key that each is in."""
    import numpy as np
    import pyarrow as pa

    keys, nodes, started = np.empty(0, "i8"), np.empty(0, "i8"), 0  # the last row so far, and rows of its key before it
    for b in itertools.chain(batches, [None]):
        new = b is not None
        k = np.concatenate([keys, b.column(0).to_numpy()]) if new else keys
        n = np.concatenate([nodes, b.column(1).to_numpy()]) if new else nodes
        if not len(k):
            continue
        first = np.r_[True, k[1:] != k[:-1]]
        start = np.maximum.accumulate(np.where(first, np.arange(len(k)), 0))
        rank = np.arange(len(k)) - start + np.where(start == 0, started, 0)
        same = k[1:] == k[:-1]
        live = np.r_[started > 0, same] | np.r_[same, False]
        live = live | (rank > 0)
        done = len(k) - 1 if new else len(k)  # the last row waits for the next batch
        keys, nodes, started = k[done:], n[done:], int(rank[-1])
        at = np.flatnonzero(live[:done])
        yield pa.record_batch([pa.array(k[at]), pa.array((rank[at] // part_rows).astype("i4")), pa.array(n[at])], ["key", "part", "node"])


def _groups(batches: Iterator, by: int) -> Iterator:
    """Tables of whole groups, of batches in order of their first `by` columns: yields (table, bounds of groups in it)."""
    import numpy as np
    import pyarrow as pa

    rest = None
    for b in itertools.chain(batches, [None]):
        if b is not None:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            rest = t if rest is None else pa.concat_tables([rest, t])
        if rest is None or not rest.num_rows:
            continue
        cols = [rest.column(i).to_numpy() for i in range(by)]
        new = reduce(np.logical_or, (c[1:] != c[:-1] for c in cols))
        cuts = np.r_[0, np.flatnonzero(new) + 1, rest.num_rows]
        if b is not None:
            cuts = cuts[:-1]  # the last group may go on
        if len(cuts) > 1:
            yield rest.slice(0, int(cuts[-1])), cuts
            rest = rest.slice(int(cuts[-1]))


def _briefs(column, words: int):
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, words)


def _meet(batches: Iterator, bound: int, words: int, turn: int, part_rows: int) -> Iterator:
    """Of (key, part, node, comp, brief): each member's nearest of those before it, in an order of the turn's, that is
    within the bound and of another component: (node, distance, partner). Partner is null for one that is near to a later
    one only, or may be near to one in another part of the key."""
    import numpy as np
    import pyarrow as pa

    for t, cuts in _groups(batches, 2):
        node, comp, part = t.column("node").to_numpy(), t.column("comp").to_numpy(), t.column("part").to_numpy()
        short, rank = _briefs(t.column("brief"), words), _mixed(node ^ turn)
        size = np.diff(cuts)
        out: list[list] = [[], [], []]
        two = cuts[:-1][size == 2]
        d = differing(short[two], short[two + 1])
        near = (d <= bound) & (comp[two] != comp[two + 1])
        i, d = two[near], d[near]
        later = rank[i] > rank[i + 1]
        out[0].append(np.where(later, node[i], node[i + 1]))
        out[1].append(d)
        out[2].append(np.where(later, node[i + 1], node[i]))
        alone = np.repeat(size, size) <= 2
        lone = [np.where(later, node[i + 1], node[i]), node[alone & (part > 0)]]
        for lo, n in zip(cuts[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
            order = lo + np.argsort(rank[lo : lo + n])
            own, of, s = node[order], comp[order], short[order]
            marked = np.full(n, n >= part_rows or part[lo] > 0)
            for at in range(0, n, STEP):
                d = differing(s[at : at + STEP, None, :], s[None, : at + STEP, :])
                far = (of[at : at + STEP, None] == of[None, : at + STEP]) | (d > bound)
                far |= np.arange(d.shape[1])[None, :] >= np.arange(at, at + d.shape[0])[:, None]
                marked[: d.shape[1]] |= ~far.all(axis=0)
                d = np.where(far, 1 << 20, d.astype("i4"))
                best = d.argmin(axis=1)
                d = d[np.arange(len(d)), best]
                hit = np.flatnonzero(d <= bound)
                out[0].append(own[at + hit])
                out[1].append(d[hit])
                out[2].append(own[best[hit]])
            lone.append(own[marked])
        lone = np.unique(np.concatenate(lone))
        a, d, b = (np.concatenate(x) for x in out)
        best = np.lexsort((b, d, a))
        a, d, b = a[best], d[best], b[best]
        first = np.r_[True, a[1:] != a[:-1]] if len(a) else np.empty(0, bool)
        a, d, b = a[first], d[first], b[first]
        lone = np.setdiff1d(lone, a, assume_unique=True)
        yield pa.record_batch(
            [pa.array(np.r_[a, lone], pa.int64()), pa.array(np.r_[d, np.full(len(lone), 1 << 20)], pa.int32()), pa.array(np.r_[b, lone], pa.int64(), mask=np.r_[np.zeros(len(a), bool), np.ones(len(lone), bool)])],
            ["node", "d", "partner"],
        )


def _sets(batches: Iterator, k: int) -> Iterator:
    """(node, hashes) of (node, text); a row like the one before it is left out."""
    import pyarrow as pa

    last = None
    for b in batches:
        node, out = [], []
        for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if i != last:
                node.append(i)
                out.append(shingle_set(t.as_py().encode(), k).tobytes())
            last = i
        yield pa.record_batch([pa.array(node, pa.int64()), pa.array(out, pa.binary())], ["node", "hashes"])


class _Linked:
    """Components of the labels in one group."""

    def __init__(self):
        self.top: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.top.get(x, x)) != x:
            self.top[x] = self.top.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.top[max(x, y)] = min(x, y)
        return x != y


def _confirm(batches: Iterator, num: int, den: int) -> Iterator:
    """Of (grp, side, comp, hashes) in order of grp and side: links between the sets of side 0 and of side 1, as pairs of
    their components' labels, without those that follow from others of the group."""
    import numpy as np
    import pyarrow as pa

    grp, held, labels, known = None, [], [], _Linked()
    table: tuple | None = None
    for batch in batches:
        a, b = [], []
        for g, side, comp, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            if g != grp:
                grp, held, labels, known, table = g, [], [], _Linked(), None
            own = np.frombuffer(raw.as_py(), "u8")
            if side == 0:
                held.append(own)
                labels.append(comp)
                continue
            if table is None:
                size = np.array([len(s) for s in held], "i8")
                joined = np.concatenate([*held, np.empty(0, "u8")])
                order = np.argsort(joined, kind="stable")
                table = joined[order], np.repeat(np.arange(len(held)), size)[order], size
                held = []
            values, owner, size = table
            if all(known.find(x) == known.find(comp) for x in set(labels)):
                continue
            lo, hi = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
            hit = hi > lo
            lo, n = lo[hit], (hi - lo)[hit]
            if not len(n):
                continue
            at = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            both = np.bincount(owner[at], minlength=len(size))
            for j in np.flatnonzero(den * both >= num * (size + len(own) - both)).tolist():
                if known.join(comp, labels[j]):
                    a.append(comp)
                    b.append(labels[j])
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _block_pairs(batches: Iterator, bound: int, words: int) -> Iterator:
    """Of (key, i, j, side, node, comp, block, brief): the pairs of blocks (lo, hi) that hold members within the bound of
    each other and of different components. Side 0 meets side 1, or itself where i = j."""
    import numpy as np
    import pyarrow as pa

    known: set[tuple[int, int]] = set()  # of this task, and bounded
    for t, cuts in _groups(batches, 3):
        comp, block, side, part_i, part_j = (t.column(c).to_numpy() for c in ("comp", "block", "side", "i", "j"))
        short = _briefs(t.column("brief"), words)
        found: set[tuple[int, int]] = set()
        for lo, hi in itertools.pairwise(cuts.tolist()):
            label, n = np.unique(comp[lo:hi], return_counts=True)
            if len(label) < 2:
                continue
            order = lo + np.argsort(block[lo:hi], kind="stable")
            left, right = order[side[order] == 0], order[side[order] == 1]
            if part_i[lo] == part_j[lo]:
                left = right = order
            # of two components one isn't the largest
            for x, y in ((left, right), (right, left))[: 1 if left is right else 2]:
                x = x[comp[x] != label[n.argmax()]]
                if not len(x) or not len(y):
                    continue
                theirs = np.flatnonzero(np.r_[True, block[y][1:] != block[y][:-1]])
                for at in range(0, len(x), STEP):
                    p = x[at : at + STEP]
                    near = (differing(short[p][:, None, :], short[y][None, :, :]) <= bound) & (comp[p][:, None] != comp[y][None, :])
                    if near.any():
                        mine = np.flatnonzero(np.r_[True, block[p][1:] != block[p][:-1]])
                        u, v = np.nonzero(np.logical_or.reduceat(np.logical_or.reduceat(near, theirs, axis=1), mine, axis=0))
                        u, v = block[p[mine[u]]], block[y[theirs[v]]]
                        found.update(zip(np.minimum(u, v).tolist(), np.maximum(u, v).tolist(), strict=True))
        new = np.array(sorted(found - known), "i8").reshape(-1, 2)
        known = found if len(known) > 500_000 else known | found
        yield pa.record_batch([pa.array(new[:, 0]), pa.array(new[:, 1])], ["lo", "hi"])


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("string")))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, for each row. Rows whose sets of shingles have
    den * intersection >= num * union are linked. Options are those of grouped()."""
    out = grouped(docs, **options)
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def grouped(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, positions: int = 64, key: str = "doc_id", text: str = "text", meetings: int = 2, part_rows: int = PART_ROWS, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """doc_id, digest of the text, n_shingles, component_id and first, for each row. first is the row that stands for
    the component, by (no doc_id, doc_id, digest); component_id and first are null for rows without shingles. The numbers
    of meetings, rows in a part and nodes in a block change the way and not the result."""
    prepare(docs.sparkSession)
    if positions % 16:
        raise ValueError("positions must be a multiple of 16")
    bound, words = distance_bound(num, den, positions), positions // 16
    plan = chunk_plan(positions, bound)
    src = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), _digest(F.col(text)).alias("digest"))
    signed = save(src.mapInArrow(lambda it: _sign(it, shingle, positions), "doc_id long, n_shingles long, set_key binary, sig binary, brief binary, digest binary"), "signatures")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    classes = signed.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.min(row).alias("first"), F.first("sig").alias("sig"), F.first("brief").alias("brief"), F.first("n_shingles").alias("n"))
    classes = save(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    keys = classes.select("node", "sig").mapInArrow(lambda it: _keys(it, plan, positions), "key long, node long")
    keys = keys.repartition("key").sortWithinPartitions("key", F.xxhash64("key", "node"))
    live = save(keys.mapInArrow(lambda it: _shared(it, part_rows), "key long, part int, node long"), "live")  # members of keys that several have

    def meet(rows: DataFrame, turn: int) -> DataFrame:
        """(node, partner), one row for each node that is near to any of another component."""
        rows = rows.repartition("key", "part").sortWithinPartitions("key", "part").select("key", "part", "node", "comp", "brief")
        met = rows.mapInArrow(lambda it: _meet(it, bound, words, turn, part_rows), "node long, d int, partner long")
        return met.groupBy("node").agg(F.min(F.struct("d", "partner")).alias("best")).select("node", F.col("best.partner").alias("partner"))

    def confirm(members: DataFrame, name: str) -> DataFrame:
        """Components' labels that turn out to be linked, of members (grp, side, node, comp)."""
        rows = members.join(sets, "node").select("grp", "side", "comp", "hashes")
        rows = rows.repartition("grp").sortWithinPartitions("grp", "side")
        return save(rows.mapInArrow(lambda it: _confirm(it, num, den), "a long, b long").distinct(), name)

    def joined(nodes: DataFrame, links: DataFrame) -> DataFrame:
        """nodes with the labels that links leave."""
        new = components(links)
        out = nodes.join(new.select(F.col("node").alias("comp"), F.col("comp").alias("into")), "comp", "left")
        out = save(out.select("node", F.coalesce("into", "comp").alias("comp"), "n", "brief"), "nodes")
        drop(new, links)
        return out

    rows = live.join(classes.select("node", "brief"), "node").withColumn("comp", F.col("node"))
    met = save(meet(rows, 0), "met0")
    near = met.select("node").union(met.where("partner IS NOT NULL").select("partner")).distinct()
    near = near.join(classes.select("node", "n", "brief", F.col("first.doc_id").alias("of"), F.col("first.digest").alias("own")), "node")
    near = save(near, "near")
    texts = src.join(near.select("node", "of", "own").hint("merge"), (F.col("digest") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("of")))
    sets = save(texts.select("node", "text").mapInArrow(lambda it: _sets(it, shingle), "node long, hashes binary"), "sets")
    nodes = near.select("node", F.col("node").alias("comp"), "n", "brief")
    tables = [live, met, near, sets]

    def open_rows() -> DataFrame:
        """Members of keys that have several components among the near."""
        rows = live.join(nodes, "node")
        spread = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("part").alias("last")).where("lo <> hi").select("key", "last")
        return rows.join(spread, "key")

    for turn in range(meetings):
        if turn:
            met = save(meet(open_rows(), turn), f"met{turn}")
            tables.append(met)
        pairs = met.where("partner IS NOT NULL")
        if turn:
            label = nodes.select(F.col("node").alias("partner"), F.col("comp").alias("into"))
            pairs = pairs.join(nodes.select("node", "comp"), "node").join(label, "partner")
        else:
            pairs = pairs.withColumns({"comp": F.col("node"), "into": F.col("partner")})
        # a partner of many meets them in several groups
        pairs = pairs.withColumn("grp", F.xxhash64("partner", F.pmod(F.xxhash64("node"), F.lit(SALTS))))
        hosts = pairs.select("grp", F.lit(0).alias("side"), F.col("partner").alias("node"), F.col("into").alias("comp")).distinct()
        links = confirm(hosts.union(pairs.select("grp", F.lit(1).alias("side"), "node", "comp")), f"links{turn}")
        nodes = joined(nodes, links)
        tables.append(nodes)

    # Blocks: what is left is mostly a large component and others that are near to it. A member's home is the larger of
    # its own component and that of its nearest; there, members and others have blocks of their own.
    rest = save(open_rows().select("key", "part", "last", "node", "comp", "n", "brief"), "open")
    sized = nodes.select("node", "comp", "n").join(nodes.groupBy("comp").agg(F.count(F.lit(1)).alias("members")), "comp")
    sized = save(sized.select("node", "n", F.struct("members", "comp").alias("own")), "sized")
    nearest = met.where("partner IS NOT NULL").join(sized.select(F.col("node").alias("partner"), F.col("own").alias("their")), "partner").select("node", "their")
    homes = rest.select("node").distinct().join(sized, "node").join(nearest, "node", "left")
    homes = homes.select("node", "n", F.xxhash64(F.greatest("own", F.coalesce("their", "own")), F.col("own") < F.col("their")).alias("home"), F.pmod(F.xxhash64("node"), F.lit(SALTS)).alias("salt"))
    homes = save(homes, "homes")
    full = homes.groupBy("home").agg(F.ceil(F.greatest(F.count(F.lit(1)) / block_nodes, F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    full = full.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
    block = F.xxhash64("home", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")))
    blocks = save(homes.join(full, ["home", "salt"]).select("node", block.alias("block")), "blocks")
    rows = rest.join(blocks, "node")
    # parts of a key in pairs: each goes with itself and with each other one
    other = F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other")
    tiles = rows.select("*", other).select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), (F.col("part") > F.col("other")).cast("int").alias("side"), "node", "comp", "block", "brief")
    tiles = tiles.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    met_blocks = save(tiles.mapInArrow(lambda it: _block_pairs(it, bound, words), "lo long, hi long").distinct().withColumn("grp", F.xxhash64("lo", "hi")), "met_blocks")
    held = blocks.join(nodes.select("node", "comp"), "node")
    members = reduce(DataFrame.union, (met_blocks.withColumnRenamed(end, "block").join(held, "block").select("grp", F.lit(side).alias("side"), "node", "comp") for side, end in enumerate(("lo", "hi"))))
    nodes = joined(nodes, confirm(members, "links"))
    drop(*tables, rest, sized, homes, blocks, met_blocks)

    named = classes.join(nodes.select("node", "comp"), "node", "left").select("set_key", "rep", "first", F.coalesce("comp", "node").alias("comp"))
    smallest = named.groupBy("comp").agg(F.min("rep").alias("component_id"), F.min("first").alias("first"))
    of_class = named.select("set_key", "comp").join(smallest, "comp").select("set_key", "component_id", "first")
    return signed.select("doc_id", "digest", "n_shingles", "set_key").join(of_class, "set_key", "left").select("doc_id", "digest", "n_shingles", "component_id", "first")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents under three-word shingles at similarity 0.85."""
    return near_duplicates(documents(spark, sf_dir), shingle=3, num=85)


def keep(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without the rows that a group of near-duplicates can spare: one row of each group stays, of those with the
    smallest doc_id (rows without one come last) that with the smallest digest of its text. Rows of one doc_id and other
    texts are rows of their own. Rows without words are in no group and stay."""
    out = grouped(docs, key=key, text=text, **options).where("n_shingles > 0")
    spared = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest")))
    out = save(out.select("doc_id", "digest", spared.alias("spared")), "kept")
    own, mark = unused(docs, "own"), unused(docs, "mark")
    gone = out.where("spared").select(F.col("doc_id").alias(own), F.col("digest").alias(mark)).distinct()
    left = docs.join(gone, docs[key].cast("long").eqNullSafe(gone[own]) & (_digest(docs[text]) == gone[mark]), "left_anti")
    if out.where("NOT spared").groupBy("doc_id", "digest").count().where("count > 1").limit(1).count():  # else no row repeats another
        words = F.coalesce(F.col(text).cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
        rows = left.where(words).withColumns({own: F.col(key).cast("long"), mark: _digest(F.col(text))})
        left = rows.dropDuplicates([own, mark]).drop(own, mark).unionByName(left.where(~words))
    return left


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
x AS (SELECT doc_id, len(s) AS c, unnest(s) AS x FROM s),
p AS (
  SELECT a.doc_id AS i, b.doc_id AS j FROM x AS a JOIN x AS b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.c, b.c HAVING 100 * count(*) >= 85 * (a.c + b.c - count(*))),
e AS (SELECT i, j FROM p UNION ALL SELECT j, i FROM p),
r(i, j) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.i, e.j FROM r JOIN e ON r.j = e.i),
m AS (SELECT i, min(j) AS component_id FROM r GROUP BY i)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept FROM s JOIN m ON s.doc_id = m.i
"""
