"""Mixing sources to target weights along a curriculum whose weights change over training.

Sizes are words. Targets come from water-filling: sources share the total by weight, none above ``limit`` times its
own size. Over curriculum time t in [0, 1] a source draws words at the rate target * s(t). Its schedule s is given by
rates at equal steps of t, between which it is linear, and scaled to integrate to 1. The cumulative demand
D(t) = target * (integral of s up to t) is piecewise quadratic and inverted in closed form: a document whose words begin
at c of the source's stream stands at the t with D(t) = c. t is the curriculum's time; the share of all words that come
before it is the sum of the sources' demands, which is t itself only where the schedules cancel out.
A source's stream repeats its documents, in an order drawn by md5 of doc_id, until the target is reached; the last
document of the stream gives its leading words only. ``training_order`` range-sorts all copies by position.
"""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, Scratch, running_sum, table, utf8

#: Schedules of the sources, repeating in source order: late, level, early.
SCHEDULES = ((0.5, 1.5), (1.0, 1.0), (1.5, 0.5))


def word_count(name: str):
    """Number of words of a text: pieces between white space, without the empty ones at the ends."""
    text = F.regexp_replace(utf8(name), f"^{SPACE}|{SPACE}$", "")
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, SPACE))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: int = 3) -> DataFrame:
    """(source, source_size) -> also nth (from 0), weight, target. One row a source, so one window holds them all: sources
    are a closed list of some millions at most, not one for each document.

    Sources by code point, null last. In the order of limit * size / weight, a source is full if its share of what
    the full sources before it leave exceeds its limit; the first that isn't sets the share of all others.
    """
    ranked = sizes.withColumn("nth", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int")).cast("double"))
    by_fill = Window.orderBy(F.col("source_size") / F.col("weight"), "nth")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everywhere).cast("double")
    full_words = F.coalesce(F.sum("source_size").over(before), F.lit(0)) * float(limit)
    full_weight = F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    shared = ranked.withColumn("rate", (total - full_words) / (F.sum("weight").over(everywhere) - full_weight))
    shared = shared.withColumn("full", F.col("rate") * F.col("weight") > F.col("source_size") * float(limit))
    rate = F.min_by(F.when(~F.col("full"), F.col("rate")), F.when(~F.col("full"), F.struct(F.col("source_size") / F.col("weight"), F.col("nth")))).over(everywhere)
    target = F.least(F.coalesce(rate * F.col("weight"), F.lit(0.0)), F.col("source_size") * float(limit))
    return shared.withColumn("target", target).select("source", "source_size", "nth", "weight", "target")


def mix(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, size, source_size, target, nth, cum, taken) of each row; nth: the source's place, cum: words of the
    source before it.

    Null text has size 0; null is a source of its own, the last; an empty table stays empty; rows that share a
    doc_id are ordered by size and count one by one; rows without a doc_id are drawn by their text. Columns other than
    doc_id, source, text and ``keep`` are ignored.
    """
    scratch = Scratch(spark, "mixing")
    # null ids are drawn by their text as well, so that they are not one hot place of the order
    unknown = F.when(F.col("doc_id").isNull(), F.md5(utf8("text"))).otherwise(F.md5(F.col("doc_id").cast("string")))
    sized = docs.select("doc_id", "source", *keep, word_count("text").alias("size"), unknown.alias("draw"))
    # words are counted once, not once for the bounds of the ranges and once to deal out the rows
    sized = scratch.table(sized, "words")
    summed = running_sum(scratch, sized, "sized", ["draw", "doc_id", "size", *keep], {"cum": "size"}, per="source")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, limit).withColumnRenamed("source", "_source")
    mixed = summed.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    goal = F.round("target").cast("long")
    laps = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as long) div source_size")).otherwise(F.lit(0).cast("long"))
    last = F.greatest(F.lit(0), F.least(F.col("size"), goal - laps * F.col("source_size") - F.col("cum"))).cast("long")
    return mixed.withColumn("taken", F.when(F.col("source_size") > 0, laps * F.col("size") + last).otherwise(F.lit(0).cast("long"))).select("doc_id", *keep, "source", "size", "source_size", "target", "nth", "cum", "taken")


def inverse(share: Column, rates: tuple[float, ...]) -> Column:
    """The t at which a schedule has a share of its integral behind it."""
    if len(rates) < 2 or min(rates) < 0 or not sum(rates):
        raise ValueError("a schedule has two rates or more, none negative and not all zero")
    step = 1.0 / (len(rates) - 1)
    whole = sum((p + q) / 2 * step for p, q in pairwise(rates))
    rates = [r / whole for r in rates]
    before, out = 0.0, None
    for j, (p, q) in enumerate(pairwise(rates)):
        slope, past = (q - p) / step, share - F.lit(before)
        if slope:
            x = F.abs((F.sqrt(F.greatest(F.lit(0.0), F.lit(p * p) + F.lit(2 * slope) * past)) - F.lit(p)) / F.lit(slope))
        else:
            x = past / F.lit(p) if p else F.lit(0.0)
        at = F.least(F.lit(1.0), F.lit(j * step) + x)
        out = at if out is None else F.when(share >= F.lit(before), at).otherwise(out)
        before += (p + q) / 2 * step
    return out


def position(begin: Column, schedules: tuple[tuple[float, ...], ...] = SCHEDULES) -> Column:
    """The t in [0, 1] at which the source's cumulative demand reaches ``begin`` words."""
    share = F.least(F.lit(1.0), begin.cast("double") / F.col("target"))
    out = F.lit(None).cast("double")
    for i, rates in enumerate(schedules):
        out = F.when(F.col("nth") % len(schedules) == i, inverse(share, rates)).otherwise(out)
    return out


def training_order(mixed: DataFrame, schedules: tuple[tuple[float, ...], ...] = SCHEDULES) -> DataFrame:
    """One row per copy that the mix takes: also copy, words of it, and position; range-sorted by position."""
    copies = mixed.where("taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.expr("cast((taken + size - 1) div size as int) - 1"))))
    words = F.least(F.col("size"), F.col("taken") - F.col("copy") * F.col("size"))
    placed = copies.withColumn("words", words.cast("long")).withColumn("position", position(F.col("copy") * F.col("source_size") + F.col("cum"), schedules))
    return placed.repartitionByRange("position", "doc_id", "copy").sortWithinPartitions("position", "doc_id", "copy")


def op6_mixing(spark: SparkSession, sf_dir: str, schedules: tuple[tuple[float, ...], ...] = SCHEDULES) -> DataFrame:
    """Each document's share of the mix and the position of its first copy (null: not taken), range-sorted by it."""
    mixed = mix(spark, table(spark, sf_dir, "documents"))
    first = F.when(F.col("taken") > 0, F.round(position(F.col("cum"), schedules), 9)).alias("first_position")
    out = mixed.select("doc_id", "size", "source_size", "target", "taken", first)
    return out.repartitionByRange(F.col("first_position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("first_position").asc_nulls_last(), "doc_id")


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS draw
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM sources),
weighed AS (SELECT *, CAST(nth % 3 + 1 AS DOUBLE) AS weight, CASE nth % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE -0.5::DOUBLE END AS ramp FROM ranked),
shared AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - 3.0::DOUBLE * coalesce(sum(source_size) OVER b, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS rate
  FROM weighed WINDOW b AS (ORDER BY source_size / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT rate AS r FROM shared WHERE NOT rate * weight > 3.0::DOUBLE * source_size ORDER BY source_size / weight, nth LIMIT 1),
targets AS (SELECT source, source_size, ramp, least(coalesce((SELECT r FROM level) * weight, 0), 3.0::DOUBLE * source_size) AS target FROM shared),
placed AS (
  SELECT s.*, t.source_size, t.ramp, t.target,
         CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.draw, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cum
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
taken AS (
  SELECT *, CASE WHEN source_size > 0 THEN (CAST(round(target) AS BIGINT) // source_size) * size
    + greatest(0, least(size, CAST(round(target) AS BIGINT) - (CAST(round(target) AS BIGINT) // source_size) * source_size - cum)) ELSE 0 END AS taken,
    least(1.0::DOUBLE, CAST(cum AS DOUBLE) / target) AS share FROM placed)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken,
  CASE WHEN taken > 0 THEN round(CASE WHEN ramp = 0 THEN share
    ELSE abs((sqrt(greatest(0.0::DOUBLE, (1.0::DOUBLE - ramp) * (1.0::DOUBLE - ramp) + 4.0::DOUBLE * ramp * share)) - (1.0::DOUBLE - ramp)) / (2.0::DOUBLE * ramp)) END, 9) END AS first_position
FROM taken
"""
