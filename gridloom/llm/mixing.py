"""Mixing sources to target weights by hash-threshold histograms (operator 4).

Every document takes ``floor(target / source size)`` whole copies, and the documents whose
hash lies below their source's threshold take one more. The threshold is found without
sorting: words are summed by source and hash bucket, the bucket in which the budget ends is
the only one that is refined, ``LEVELS`` times by ``BITS`` bits, and the document at the
boundary is taken when that brings the source nearer to its target.

Defined results: null text has size 0; a null source is a source of its own, last in order;
rows with equal doc_id are taken or left together, repeated rows count each; an empty table
gives an empty result; sources without words have target 0. Other columns are ignored
(``mix``) or kept (``mixed_rows``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.scratch import spread, written
from gridloom.llm.words import word_counts

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BITS, LEVELS = 12, 4
#: Rows of the sources' table (under 100 bytes each) up to which it is sent to every task.
BROADCAST_SOURCES = 50_000


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pa.array(word_counts(batch.column(2)), type=pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sizes], ["doc_id", "source", "size"])


def hash48(doc_id: Column) -> Column:
    """The first 48 bits of an md5 of the id; the same in any SQL engine."""
    digest = F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def sized(documents: DataFrame) -> DataFrame:
    """doc_id, source, size (words) and the 48-bit hash of doc_id."""
    own = spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")))
    counted = own.mapInArrow(_sizes, "doc_id long, source string, size long")
    return counted.withColumn("h", hash48(F.col("doc_id")))


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """``sources`` (source, source_size) with each source's target.

    Filling to a common level: with sources in order of cap / weight, those below the level
    are capped at ``most`` times their size and the rest share what is left by weight. One
    row per source; the windows run over that table alone.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    ranked = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(1))
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    level = left.cast("double") / F.sum("weight").over(after)
    filled = ranked.withColumn("level", level).withColumn("open", F.col("level") <= F.col("cap") / F.col("weight"))
    common = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level").alias("level")))).over(every)["level"]
    target = F.least(F.col("cap").cast("double"), F.coalesce(common, F.lit(0.0)) * F.col("weight"))
    return filled.select("source", "source_size", target.alias("target"))


def _beside(table: DataFrame, sources: int) -> DataFrame:
    """The table of sources, broadcast while its counted rows stay within ``BROADCAST_SOURCES``."""
    return F.broadcast(table) if sources <= BROADCAST_SOURCES else table


def _thresholds(documents: DataFrame, budgets: DataFrame, sources: int) -> DataFrame:
    """source, threshold: documents of lower hash take one more copy.

    ``first`` is the start of the bucket in which the budget ends and ``before`` the words in front of it.
    """
    state = budgets.select("source", "budget", F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("before"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - level - 1)
        width = 1 << shift
        inside = documents.alias("d").join(_beside(state, sources).alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
        if level:
            inside = inside.where((F.col("d.h") >= F.col("s.first")) & (F.col("d.h") < F.col("s.first") + (width << BITS)))
        slot = F.floor(F.col("d.h") / F.lit(width)).cast("long") * F.lit(width)
        histogram = inside.groupBy(F.col("d.source").alias("source"), slot.alias("slot")).agg(F.sum("d.size").alias("words"))
        inside_bucket = Window.partitionBy("source").orderBy("slot")
        running = histogram.withColumn("upto", F.sum("words").over(inside_bucket))
        ends = running.alias("r").join(_beside(state, sources).alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
        found = ends.where(F.col("s.before") + F.col("r.upto") > F.col("s.budget")).groupBy(F.col("s.source").alias("source")).agg(F.min_by(F.struct("r.slot", (F.col("s.before") + F.col("r.upto") - F.col("r.words")).alias("before"), F.col("r.words").alias("words")), F.col("r.slot")).alias("end"))
        state = budgets.alias("b").join(found.alias("f"), F.col("b.source").eqNullSafe(F.col("f.source")), "left").select(
            "b.source", "b.budget", F.coalesce("f.end.slot", F.lit(1 << 62)).alias("first"), F.coalesce("f.end.before", F.lit(0)).alias("before"), F.coalesce("f.end.words", F.lit(0)).alias("words")
        )
    over, under = F.col("before") + F.col("words") - F.col("budget"), F.col("budget") - F.col("before")
    return state.select("source", F.when(over < under, F.col("first") + 1).otherwise(F.col("first")).alias("threshold"))


def _limits(own: DataFrame, weights: Sequence[float], most: int) -> DataFrame:
    """source, source_size, target, whole copies, budget beyond them and hash threshold; one row per source."""
    totals = own.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = targets(totals, weights, most)
    ratio = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goals = goals.withColumn("whole", F.least(ratio, F.lit(most).cast("long"))).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    goals = written(goals, "mix-targets")
    ends = _thresholds(own, goals, goals.count())
    return written(goals.alias("g").join(ends.alias("t"), F.col("g.source").eqNullSafe(F.col("t.source")), "left").select("g.*", "t.threshold"), "mix-limits")


def _copies(h: Column, most: int) -> Column:
    return F.col("g.whole") + F.when((h < F.col("g.threshold")) & (F.col("g.whole") < most), 1).otherwise(0)


def mix(documents: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every document."""
    own = written(sized(documents), "mix-sizes")
    limits = _limits(own, weights, most)
    joined = own.alias("d").join(_beside(limits, limits.count()).alias("g"), F.col("d.source").eqNullSafe(F.col("g.source")))
    copies = _copies(F.col("d.h"), most)
    return joined.select("d.doc_id", "d.source", "d.size", "g.source_size", "g.target", copies.alias("copies"), (copies * F.col("d.size")).alias("taken"))


def mixed_rows(documents: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """The mix itself: every document as many times as it is taken, with all its columns.

    The decision follows from the row's hash and its source's threshold, so no decision is
    joined back to a text; the only join is with the table of sources.
    """
    own = written(sized(documents), "mix-sizes")
    limits = _limits(own, weights, most)
    joined = documents.alias("d").join(_beside(limits, limits.count()).alias("g"), F.col("d.source").cast("string").eqNullSafe(F.col("g.source")))
    copies = _copies(hash48(F.col("d.doc_id").cast("long")), most).cast("int")
    return joined.where(copies > 0).select("d.*", F.explode(F.array_repeat(F.lit(1), copies)).alias("__turn")).drop("__turn")


ORACLE = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
             source_size * 3 AS cap FROM s),
v AS (SELECT *, CAST((sum(source_size) OVER ()) - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
             / sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
l AS (SELECT arg_min(level, cap / weight) AS level FROM v WHERE level <= cap / weight),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce((SELECT level FROM l), 0.0) * weight) AS target FROM v),
b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(least(floor(target / source_size), 3) AS BIGINT) ELSE 0 END AS whole FROM t),
r AS (SELECT d.*, b.source_size, b.target, b.whole, b.target - b.whole * b.source_size AS budget,
             sum(size) OVER (PARTITION BY d.source ORDER BY h) AS upto,
             sum(size) OVER (PARTITION BY d.source, h) AS own
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN whole < 3 AND (upto <= budget OR (upto - own <= budget AND upto - budget < budget - (upto - own))) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))
