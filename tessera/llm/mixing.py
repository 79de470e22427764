"""Mixing sources to target weights along a time-varying curriculum, in DataFrame functions only.

Each source has a schedule: its weight over training time 0 to 1, linear between knots. The schedule's integral is
the source's share. Targets are shares of the mix, held to `max_repeats` times what a source has, with the excess
reshared by weight until none is above; sorting sources by cap / weight gives that in one pass of running sums. The
source's documents, in a hashed order, are laid end to end, pass after pass; the words before a document are a point
of the source's cumulative demand, and inverting the schedule's integral there gives the document's position in
training. A range sort by position is the training order.

Running sums over a source are taken in two steps, over buckets of the hashed order and inside them, so that no source,
however large, is one task's work. The order hashes doc_id; where rows without a doc_id, or of one doc_id, fill a bucket
beyond twice its measure, it is split by where the rows stand in the input.

Defined cases. Null text has size 0 and is never taken. A null source is a source of its own, after the others. Rows
that repeat a doc_id are documents of their own; equal rows are interchangeable. An empty table gives no rows, and a
mix without words takes none. Other columns are ignored, whatever their names. A mix that keeps columns reads docs
twice, and docs must give the same rows in the same order then, as files and written tables do.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, documents, save

Schedule = Sequence[tuple[float, float]]
#: Weights 3, 1, 2 on the whole: the first rises, the second stays, the third falls.
CURRICULUM: tuple[Schedule, ...] = (((0.0, 2.0), (1.0, 4.0)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 3.0), (1.0, 1.0)))
BUCKET_ROWS = 4096
BROADCAST_SOURCES = 10_000


def integral(schedule: Schedule) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False))


def _segments(schedule: Schedule) -> Column:
    """The schedule's linear parts, each with the integral up to it."""
    done, out = 0.0, []
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        area = (t1 - t0) * (w0 + w1) / 2
        out.append(F.struct(F.lit(float(t0)).alias("t"), F.lit(float(w0)).alias("w"), F.lit((w1 - w0) / (t1 - t0)).alias("slope"), F.lit(done).alias("done"), F.lit(done + area).alias("upto")))
        done += area
    return F.array(*out)


def invert(schedules: Sequence[Schedule], which: Column, share: Column) -> Column:
    """The time at which schedule number `which` has spent `share` (0 to 1) of its integral."""
    segs = F.element_at(F.array(*(_segments(s) for s in schedules)), which + 1)
    need = share * F.element_at(segs, -1)["upto"]
    seg = F.element_at(F.filter(segs, lambda s: (need <= s["upto"]) | (s["upto"] == F.element_at(segs, -1)["upto"])), 1)
    y = need - seg["done"]
    root = F.sqrt(F.greatest(F.lit(0.0), seg["w"] * seg["w"] + 2 * seg["slope"] * y))
    return seg["t"] + F.when(y > 0, 2 * y / (seg["w"] + root)).otherwise(F.lit(0.0))


def targets(sizes: DataFrame, weights: Sequence[float], total_share: float, max_repeats: float) -> DataFrame:
    """sizes: skey, source, source_size, n_docs, one row a source. Adds nth (of the weights), target and goal."""
    everything = Window.partitionBy()  # one row a source, all in one task: three numbers and a name each
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), F.col("nth") + 1)
    ranked = sizes.withColumn("nth", ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)).cast("int"))
    ranked = ranked.withColumn("w", w).withColumn("cap", F.lit(float(max_repeats)) * F.col("source_size"))
    ranked = ranked.withColumn("ratio", F.col("cap") / F.col("w")).withColumn("total", F.lit(float(total_share)) * F.sum("source_size").over(everything))
    order = Window.orderBy("ratio", "skey")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.col("total") - before) / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    full = ranked.withColumn("full", F.col("ratio") <= level)
    rest = F.col("total") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(everything)
    spare = F.sum(F.when(F.col("full"), F.lit(0.0)).otherwise(F.col("w"))).over(everything)
    target = F.when(F.col("full"), F.col("cap")).otherwise(rest / spare * F.col("w"))
    return full.withColumn("target", target).withColumn("goal", F.floor(F.col("target") + 0.5)).select("skey", "source", "source_size", "n_docs", "nth", "target", "goal")


def plan_mix(
    docs: DataFrame, schedules: Sequence[Schedule] = CURRICULUM, total_share: float = 1.5, max_repeats: float = 2.0, key: str = "doc_id", text: str = "text", source: str = "source", keep: Sequence[str] = ()
) -> DataFrame:
    """Per document: doc_id, size, source_size, target, goal, nth and before, the words of its source ahead of it in
    one pass; and the columns in keep, under their names with _kept_ before them."""
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    mark = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long")
    skey = F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source)))
    cols = [F.col(key).alias("doc_id"), F.col(source).alias("source"), skey.alias("skey"), words.alias("size"), mark.alias("mark"), F.xxhash64(F.col(text)).alias("tie"), F.xxhash64(F.monotonically_increasing_id()).alias("uid")]
    base = save(docs.select(*cols), "sizes")
    sizes = base.groupBy("skey", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    plan = save(targets(sizes, [integral(s) for s in schedules], total_share, max_repeats), "targets").drop("source")
    # a broadcast only where the plan is known to be small; else a join, whose skewed partitions Spark splits
    plan = F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan

    def bucketed(rows: DataFrame) -> DataFrame:
        buckets = F.ceil(F.col("n_docs") / BUCKET_ROWS)
        return rows.join(plan, "skey").withColumn("bucket", F.floor(F.col("mark") / F.lit(float(1 << 60)) * buckets))

    full = bucketed(base).groupBy("skey", "bucket").agg(F.count(F.lit(1)).alias("n"))
    full = save(full.where(F.col("n") > 2 * BUCKET_ROWS).select("skey", "bucket", F.ceil(F.col("n") / BUCKET_ROWS).alias("split")), "full")
    hot = full.count()

    def dealt(rows: DataFrame) -> DataFrame:
        """Rows with their part of a bucket: 0 but in buckets that are too full."""
        if not hot:
            return bucketed(rows).withColumn("part", F.lit(0).cast("long"))
        split = F.broadcast(full) if hot <= BROADCAST_SOURCES else full
        return bucketed(rows).join(split, ["skey", "bucket"], "left").withColumn("part", F.coalesce(F.pmod(F.col("uid"), F.col("split")), F.lit(0).cast("long")))

    ahead = Window.partitionBy("skey").orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt(base).groupBy("skey", "bucket", "part").agg(F.sum("size").alias("words"))
    sums = sums.select("skey", "bucket", "part", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("base"))
    # columns like texts are read once more, which is less than to write them above
    rows = dealt(docs.select(*cols, *(F.col(f"`{c}`").alias(f"_kept_{c}") for c in keep)) if keep else base)
    inside = Window.partitionBy("skey", "bucket", "part").orderBy("mark", "doc_id", "size", "tie", "uid").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(sums, ["skey", "bucket", "part"]).withColumn("before", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))


def copy_words(copy: Column, whole: bool) -> Column:
    """The words that pass number `copy` takes of a document: where the source's goal falls inside it, its first
    words, or if whole, all or none, whichever is nearer."""
    left = F.col("goal") - copy * F.col("source_size") - F.col("before")
    if whole:
        return F.when(left * 2 >= F.col("size"), F.col("size")).otherwise(F.lit(0)) * (left > 0).cast("long")
    return F.greatest(F.lit(0), F.least(left, F.col("size")))


def passes(max_repeats: float) -> int:
    return -int(-max_repeats // 1)


def mix(docs: DataFrame, schedules: Sequence[Schedule] = CURRICULUM, total_share: float = 1.5, max_repeats: float = 2.0, whole: bool = True, keep: Sequence[str] = (), **names: str) -> DataFrame:
    """The mix in training order: a row for each copy taken, with doc_id, copy, words, position and the columns in keep,
    which stand for the operator's own where names are the same."""
    plan = plan_mix(docs, schedules, total_share, max_repeats, keep=keep, **names)
    copies = plan.withColumn("copy", F.explode(F.array(*(F.lit(k) for k in range(passes(max_repeats))))))
    taken = copies.withColumn("words", copy_words(F.col("copy"), whole)).where("words > 0")
    spent = (F.col("copy") * F.col("source_size") + F.col("before") + F.col("words") / 2) / F.col("goal")
    placed = taken.withColumn("position", invert(schedules, F.col("nth"), F.least(spent, F.lit(1.0))))
    ordered = placed.orderBy("position", "doc_id", "copy")
    kept = [F.col(f"`_kept_{c}`").alias(c) for c in keep]
    return ordered.select(*(c for c in ("doc_id", "copy", "words", "position") if c not in keep), *kept)


def op5_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of 150% of all words takes of every document, ordered by its first place in training."""
    plan = plan_mix(documents(spark, sf_dir))
    taken = sum((copy_words(F.lit(k), False) for k in range(passes(2.0))), F.lit(0))
    first = F.least((F.col("before") + F.least(F.col("size"), F.col("goal") - F.col("before")) / 2) / F.col("goal"), F.lit(1.0))
    position = F.when(F.col("taken") > 0, invert(CURRICULUM, F.col("nth"), first))
    rows = plan.withColumn("taken", taken.cast("long")).withColumn("position", position)
    return rows.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 9).alias("position")).orderBy(F.col("position").asc_nulls_last(), "doc_id")


OP5_SQL = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS mark
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
r AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 AS nth FROM s),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][nth + 1] AS w, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM r),
o AS (SELECT *, cap / w AS ratio FROM w),
l AS (SELECT *, ratio <= (total - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY ratio, source NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS full_ FROM o),
t AS (SELECT source, source_size, nth, CASE WHEN full_ THEN cap ELSE (total - sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER ()) / sum(CASE WHEN full_ THEN 0 ELSE w END) OVER () * w END AS target FROM l),
g AS (SELECT *, floor(target + 0.5)::BIGINT AS goal FROM t),
d AS (
  SELECT b.doc_id, b.size, g.source_size, g.target, g.goal, g.nth,
         coalesce(sum(b.size) OVER (PARTITION BY b.source ORDER BY b.mark, b.doc_id, b.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before_
  FROM base b JOIN g ON b.source IS NOT DISTINCT FROM g.source),
k AS (
  SELECT *, (greatest(0, least(goal - before_, size)) + greatest(0, least(goal - source_size - before_, size)))::BIGINT AS taken,
         least((before_ + least(size, goal - before_) / 2) / goal::DOUBLE, 1.0) AS x,
         [2.0::DOUBLE, 1.0::DOUBLE, 3.0::DOUBLE][nth + 1] AS w0, [2.0::DOUBLE, 0.0::DOUBLE, -2.0::DOUBLE][nth + 1] AS slope, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][nth + 1] AS area
  FROM d)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN round(2 * x * area / (w0 + sqrt(greatest(0.0, w0 * w0 + 2 * slope * (x * area)))), 9) END AS position
FROM k
"""
