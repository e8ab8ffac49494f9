"""Mixing sources to target weights along a curriculum; DataFrame functions only.

Every source has a weight schedule over training time [0, 1], linear between its
knots. The integral of a schedule is the source's weight in the mix; targets are
shared out by these weights, none above ``REPEATS`` times its source's size. The
same integral, scaled to the target, is the source's cumulative token demand;
inverting it at the token offset of a document gives the document's training
position, and documents are range-sorted by position.

A document's offset comes from two levels of prefix sums (buckets of a source,
then rows of a bucket), so no source meets in one task, however large it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, n_words

#: No source, and so no document, is taken more often than this.
REPEATS = 3
#: Rows a bucket of the offsets aims at.
BUCKET_ROWS = 20_000


def turning_schedule(sources: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """Schedules whose integrals are ``weights`` in turn, for sources by code point, null last.

    In turn a weight rises from 0 to its double, stays, and falls from its double to 0.
    """
    rank = F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1
    ranked = sources.select("source").distinct().select("source", rank.alias("k"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.pmod("k", F.lit(len(weights))).cast("int") + 1)
    shape = F.element_at(F.array(F.lit(0.0), F.lit(1.0), F.lit(2.0)), F.pmod("k", F.lit(3)).cast("int") + 1)
    return ranked.select("source", weight.alias("w"), shape.alias("from"), F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("t")).select(
        "source", "t", (F.col("w") * (F.col("from") + F.col("t") * (2 - 2 * F.col("from")))).alias("weight")
    )


def integrated(schedule: DataFrame) -> DataFrame:
    """A row a source: ``area`` under its schedule and its segments with the area before each.

    ``schedule`` has (source, t, weight) with t in [0, 1] and weight >= 0; the
    last of several weights at one t counts as a step. A weight holds before the
    first knot and after the last one.
    """
    knots = F.array_sort(F.collect_list(F.struct(F.col("t").cast("double").alias("t"), F.col("weight").cast("double").alias("w"))))
    k = schedule.groupBy("source").agg(knots.alias("k"))
    first, last = F.get("k", F.lit(0)).w, F.element_at("k", -1).w
    k = k.select("source", F.concat(F.array(F.struct(F.lit(0.0).alias("t"), first.alias("w"))), "k", F.array(F.struct(F.lit(1.0).alias("t"), last.alias("w")))).alias("k"))
    pairs = F.filter(
        F.zip_with(F.slice("k", F.lit(1), F.size("k") - 1), F.slice("k", F.lit(2), F.size("k") - 1), lambda a, b: F.struct(a.t.alias("t0"), b.t.alias("t1"), a.w.alias("w0"), b.w.alias("w1"))),
        lambda s: s.t1 > s.t0,
    )
    k = k.select("source", pairs.alias("s"))
    area = lambda s: (s.t1 - s.t0) * (s.w0 + s.w1) / 2
    before = F.transform("s", lambda s, i: F.aggregate(F.slice("s", F.lit(1), i), F.lit(0.0), lambda acc, x: acc + area(x)))
    segments = F.zip_with("s", before, lambda s, a: F.struct(a.alias("a0"), s.t0.alias("t0"), s.t1.alias("t1"), s.w0.alias("w0"), s.w1.alias("w1")))
    return k.select("source", F.aggregate("s", F.lit(0.0), lambda acc, x: acc + area(x)).alias("area"), segments.alias("segments"))


def targets(totals: DataFrame, areas: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """Target of each source: its share of all sizes by weight, at most ``repeats`` times its size.

    What a cap frees is reshared by weight until none is above its cap. The
    level at which that ends is the largest of the levels that arise when the
    sources are capped one after another, those with the least room first, so
    one sorted pass over the sources (a row each) is enough.
    """
    cap = (repeats * F.col("source_size")).cast("double")
    room = W.orderBy(F.col("cap") / F.col("area"), F.asc_nulls_last("source"))
    t = totals.join(areas, totals.source.eqNullSafe(areas.source), "left").select(
        totals.source, "source_size", F.coalesce("area", F.lit(0.0)).alias("area"), "segments", cap.alias("cap")
    )
    every = W.partitionBy()
    weighty = t.filter("area > 0").select("*", F.sum("source_size").over(every).cast("double").alias("total"))
    capped = F.coalesce(F.sum("cap").over(room.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("area").over(room.rowsBetween(W.currentRow, W.unboundedFollowing))
    levels = weighty.select("*", ((F.col("total") - capped) / left).alias("level"))
    return levels.select("source", "source_size", "area", "segments", F.least(F.col("area") * F.max("level").over(every), "cap").alias("target"))


def position(offset: Column, target: Column, area: Column, segments: Column) -> Column:
    """Training time at which a source's cumulative demand reaches ``offset`` tokens."""
    a = offset / target * area
    seg = F.element_at(F.filter(segments, lambda s: s.a0 <= a), -1)
    rest = F.greatest(a - seg.a0, F.lit(0.0))
    root = F.sqrt(F.greatest(seg.w0 * seg.w0 + 2 * (seg.w1 - seg.w0) / (seg.t1 - seg.t0) * rest, F.lit(0.0)))
    return F.when(rest > 0, F.least(seg.t0 + 2 * rest / (seg.w0 + root), F.lit(1.0))).otherwise(seg.t0)


def mix(docs: DataFrame, schedule: DataFrame | None = None, repeats: int = REPEATS) -> DataFrame:
    """Every document with what the mix takes of it, sorted by its first training position.

    Columns: doc_id, source, size (words), source_size, target, first (offset of
    its first word in its source's stream), taken (words, repeats counted), uses
    (array of epoch, words, position: the demand is inverted at the offset of
    every use), position (of the first use; null if nothing is used, those come
    last). Without a schedule it is ``turning_schedule``. Inside a source
    documents follow a digest of id and text, so reruns agree; equal ids and null
    ids spread over all buckets by their texts.

    Null, empty and wordless texts have size 0; very long texts count whole; a
    null source is a source; repeated rows are documents of their own, whichever
    comes first; other columns, whatever their names, are ignored; no rows give
    no rows. A source without a schedule, or with a zero one, is in no row of
    the result.
    """
    text, known = F.col("text").cast("string"), F.col("doc_id").cast("string")
    key = F.md5(F.concat_ws("/", F.coalesce(known, F.lit("")), F.coalesce(F.md5(F.encode(text, "UTF-8")), F.lit(""))).cast("binary"))
    sized = cut(docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words("text").alias("size"), key.alias("key")))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    totals = cut(totals)
    rows = totals.agg(F.sum("n")).first()[0] or 0
    digits = 0
    while rows / 16**digits > BUCKET_ROWS:
        digits += 1
    areas = integrated(turning_schedule(totals) if schedule is None else schedule)
    planned = targets(totals.select("source", "source_size"), areas, repeats)

    placed = sized.withColumn("bucket", F.substring("key", 1, digits))
    sums = placed.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    before = F.coalesce(F.sum("in_bucket").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), before.alias("start"))
    starts = starts.join(planned.withColumnRenamed("source", "p"), F.col("s").eqNullSafe(F.col("p"))).drop("p")
    inside = F.sum("size").over(W.partitionBy("source", "bucket").orderBy("key", "size").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size")
    joined = placed.withColumn("inside", inside).join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    first = (F.col("start") + F.col("inside")).alias("first")
    joined = joined.select("doc_id", "source", "size", "source_size", "target", "area", "segments", first)
    whole = F.floor(F.col("target") + 0.5)
    offset = lambda e: e * F.col("source_size") + F.col("first")
    words = lambda e: F.greatest(F.lit(0), F.least(F.col("size"), whole - offset(e))).cast("long")
    at = lambda e: F.round(position(offset(e), F.col("target"), F.col("area"), F.col("segments")), 6)
    use = lambda e: F.when(words(e) > 0, F.struct(F.lit(e).alias("epoch"), words(e).alias("words"), at(e).alias("position")))
    joined = joined.withColumn("uses", F.array_compact(F.array(*map(use, range(repeats)))))
    taken = F.aggregate("uses", F.lit(0).cast("long"), lambda n, u: n + u.words)
    out = joined.select("doc_id", "source", "size", "source_size", "target", "first", taken.alias("taken"), "uses", F.get("uses", F.lit(0)).position.alias("position"))
    return out.orderBy(F.asc_nulls_last("position"), "doc_id")


def placements(mixed: DataFrame) -> DataFrame:
    """The training order: a row for each use of a document (epoch, words, position), range-sorted by position."""
    uses = mixed.select("doc_id", "source", F.inline("uses"))
    return uses.orderBy("position", "doc_id", "epoch")


def contract(docs: DataFrame) -> DataFrame:
    """A row a document of ``mix``, whose docstring defines nulls, empty and long texts, ties, repeats, empty tables and further columns."""
    use = lambda e: F.get("uses", F.lit(e)).position
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "position", *(use(e).alias(f"position_{e + 1}") for e in range(1, REPEATS)))


#: DuckDB SQL of ``contract`` over a relation named documents. Demand inverted by hand: a root for a rising weight, the
#: share itself for a flat one, one less the root of the rest for a falling one.
SQL = r"""
    WITH d AS (
      SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
             md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/' || coalesce(md5(text), '')) AS key FROM documents),
    s AS (
      SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 3 * sum(size) AS cap,
             CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w FROM d GROUP BY source),
    l AS (
      SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
    t AS (SELECT source, w, source_size, least(w * max(level) OVER (), CAST(cap AS DOUBLE)) AS target FROM l),
    o AS (
      SELECT d.*, t.w, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS whole,
             CAST(sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS BIGINT) AS f
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    k AS (
      SELECT *, greatest(0, least(size, whole - f)) AS n1, greatest(0, least(size, whole - source_size - f)) AS n2,
             greatest(0, least(size, whole - 2 * source_size - f)) AS n3,
             f / target AS a1, (source_size + f) / target AS a2, (2 * source_size + f) / target AS a3 FROM o)
    SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(n1 + n2 + n3 AS BIGINT) AS taken,
           CASE WHEN n1 > 0 THEN round(CASE w WHEN 1 THEN sqrt(a1) WHEN 2 THEN a1 ELSE a1 / (1 + sqrt(1 - a1)) END, 6) END AS position,
           CASE WHEN n2 > 0 THEN round(CASE w WHEN 1 THEN sqrt(a2) WHEN 2 THEN a2 ELSE a2 / (1 + sqrt(1 - a2)) END, 6) END AS position_2,
           CASE WHEN n3 > 0 THEN round(CASE w WHEN 1 THEN sqrt(a3) WHEN 2 THEN a3 ELSE a3 / (1 + sqrt(1 - a3)) END, 6) END AS position_3 FROM k"""
