"""Mixing sources to target weights along a curriculum.

Sources, by code point with null last, get target weights in a repeating pattern and share a
budget of words; a target stops at a multiple of its source's size and the excess goes to the
others by weight (the level at which the budget is spent is found in closed form). Within a source
documents are ordered by a hash of their id. The source's demand takes them in that order, round
after round, each document whole, the last one as far as the target goes.

The weight of a source also changes during training: it runs linearly from a start to an end
level. The integral of that schedule, scaled to the target, is the source's cumulative demand in
words at each time; the inverse of the demand at the words taken before a document is its training
position in [0, 1]. Documents are range-partitioned and sorted by position.

Prefix sums are two-level: 4096 hash buckets a source, whose totals are summed, and a window
inside each bucket. No window holds more than a 4096th of a source, so a source with a third of
all rows is spread evenly. The table of sources has one row a source.

A null text has size 0. Repeated rows are documents of their own and share their source's target.
Rows that tie in id are ordered by size and text. Extra columns are never read, whatever their
names. A source without words has target 0; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import saved

WEIGHTS = (5, 2, 1)
#: Start and end level of each weight's schedule, repeating with the weights; each has mean 1.
SCHEDULE = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
SHARE = 1.5
MOST = 2


def _sized(docs: DataFrame) -> DataFrame:
    key = F.md5(F.col("doc_id").cast("string").cast("binary"))
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), F.coalesce(key, F.lit("")).alias("key"), F.xxhash64("text").alias("tie"))


def _pick(values: tuple, rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (rank % len(values) + 1).cast("int"))


def targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, rank, source_size, target; one row a source."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighted = ranked.withColumn("weight", _pick(tuple(map(float, weights)), F.col("rank"))).withColumn("cap", (F.col("source_size") * most).cast("double"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.sum(F.col("source_size").cast("double")).over(every)
    # with the smallest caps filled, what is left a unit of weight; the largest such level spends the budget
    levels = weighted.withColumn("level", (total * share - before) / rest).withColumn("level", F.max("level").over(every))
    return levels.select("source", "rank", "source_size", F.least("cap", F.greatest(F.col("level") * F.col("weight"), F.lit(0.0))).alias("target"))


def position(done: Column, start: Column, end: Column) -> Column:
    """The time at which a demand whose rate runs from start to end has reached the part ``done`` of its total."""
    total = (start + end) / 2
    slope = end - start
    bent = (F.sqrt(start * start + 2 * slope * total * done) - start) / slope
    return F.when(slope == 0, done).otherwise(F.least(F.greatest(bent, F.lit(0.0)), F.lit(1.0)))


def curriculum(docs: DataFrame, weights: tuple = WEIGHTS, schedule: tuple = SCHEDULE, share: float = SHARE, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken, position, by position.

    taken: words the mix takes of the document, repeats counted; position: of its first use in
    training, null if it is not used. Later uses follow from ``uses``.
    """
    return _placed(docs, weights, schedule, share, most).select("doc_id", "size", "source_size", "target", "taken", "position").repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def _placed(docs: DataFrame, weights: tuple, schedule: tuple, share: float, most: int) -> DataFrame:
    sized = saved(_sized(docs))
    goal = targets(sized, weights, share, most).withColumn("goal", F.floor("target"))
    known = goal.withColumnRenamed("source", "of")
    rows = sized.join(known, sized.source.eqNullSafe(known.of)).drop("source", "of").withColumn("bucket", F.substring("key", 1, 3))
    totals = rows.groupBy("rank", "bucket").agg(F.sum("size").alias("words"))
    ahead = totals.select("rank", "bucket", (F.sum("words").over(Window.partitionBy("rank").orderBy("bucket")) - F.col("words")).alias("ahead"))
    inside = Window.partitionBy("rank", "bucket").orderBy("key", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(ahead, ["rank", "bucket"]).withColumn("before", F.col("ahead") + F.col("within"))
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("goal") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    placed = placed.withColumn("rounds", rounds)
    extra = F.least(F.greatest(F.col("goal") - F.col("rounds") * F.col("source_size") - F.col("before"), F.lit(0)), F.col("size"))
    taken = F.col("rounds") * F.col("size") + extra
    start, end = (_pick(tuple(float(x[k]) for x in schedule), F.col("rank")) for k in (0, 1))
    at = position(F.col("before") / F.greatest(F.col("goal"), F.lit(1)), start, end)
    return placed.withColumn("taken", taken.cast("bigint")).withColumn("position", F.when(F.col("taken") > 0, at)).withColumn("start", start).withColumn("end", end)


def uses(docs: DataFrame, weights: tuple = WEIGHTS, schedule: tuple = SCHEDULE, share: float = SHARE, most: int = MOST) -> DataFrame:
    """doc_id, use, words, position: a row for each time training meets a document, by position."""
    rows = _placed(docs, weights, schedule, share, most).where("taken > 0")
    each = rows.withColumn("use", F.explode(F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1)))
    words = F.least(F.col("size"), F.col("taken") - F.col("use") * F.col("size"))
    at = position((F.col("use") * F.col("source_size") + F.col("before")) / F.col("goal"), F.col("start"), F.col("end"))
    return each.select("doc_id", "use", words.alias("words"), at.alias("position")).repartitionByRange("position", "doc_id", "use").sortWithinPartitions("position", "doc_id", "use")


#: The same in DuckDB SQL.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5(doc_id::VARCHAR) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(rank % 3 + 1)::INT]::DOUBLE AS weight, (2 * source_size)::DOUBLE AS cap FROM s),
f AS (SELECT *, (sum(source_size::DOUBLE) OVER () * 1.5::DOUBLE
                 - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, rank, source_size, least(cap, greatest(max(level) OVER () * weight, 0)) AS target FROM f),
g AS (SELECT d.*, rank, source_size, target, floor(target)::BIGINT AS goal,
             (coalesce(sum(size) OVER (PARTITION BY rank ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS rounds FROM g),
k AS (SELECT *, (rounds * size + least(greatest(goal - rounds * source_size - before, 0), size))::BIGINT AS taken,
             before::DOUBLE / greatest(goal, 1)::DOUBLE AS done FROM r)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN CASE rank % 3 WHEN 1 THEN done
            WHEN 0 THEN least(greatest((sqrt(1.5::DOUBLE * 1.5::DOUBLE + 2::DOUBLE * -1.0::DOUBLE * 1.0::DOUBLE * done) - 1.5::DOUBLE) / -1.0::DOUBLE, 0), 1)
            ELSE least(greatest((sqrt(0.5::DOUBLE * 0.5::DOUBLE + 2::DOUBLE * 1.0::DOUBLE * 1.0::DOUBLE * done) - 0.5::DOUBLE) / 1.0::DOUBLE, 0), 1) END END AS position
FROM k
"""
