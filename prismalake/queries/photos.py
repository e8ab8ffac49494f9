"""Photo queries."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import timeline as tl
from ..functions.ranking import global_rank
from ..functions.text import escape_like
from ..operators import photos as ph
from . import register

S = "id, file_path, file_name, date_added, date_taken, is_favorite"
ALL = "SELECT id, file_path, file_name FROM photos WHERE NOT is_hidden AND "
JAN10, JAN20 = 1704844800000, 1705708799999
BOX = (-20.0, 40.0, -60.0, 60.0)
IN_BOX = "(latitude IS NOT NULL AND longitude IS NOT NULL AND latitude BETWEEN -20 AND 40 AND longitude BETWEEN -60 AND 60)"
NOW = datetime(2024, 1, 24, 12, tzinfo=UTC)


def hard(name: str, sql: str, **criteria) -> None:
    register(name, lambda g: ph.hard_filter(g.photos, g.faces, ph.Criteria(**criteria)).select("id", "file_path", "file_name"), ALL + sql, "photos faces")


def has_person(p: int) -> str:
    return f"EXISTS (SELECT 1 FROM faces f WHERE f.photo_id = photos.id AND f.person_id = {p} AND f.assignment_type IN ('auto', 'manual'))"


hard(
    "hard_filter",
    f"date_taken BETWEEN {JAN10} AND {JAN20} AND NOT {IN_BOX} AND {has_person(4)} AND (lower(file_name) LIKE '%img%' OR lower(coalesce(relative_path, '')) LIKE '%img%')",
    start_ms=JAN10, end_ms=JAN20, box=BOX, geo_negated=True, persons=((4, False),), text="Img",
)
hard("filter_date_between", f"date_taken BETWEEN {JAN10} AND {JAN20}", start_ms=JAN10, end_ms=JAN20)
hard("filter_date_not_between", f"date_taken NOT BETWEEN {JAN10} AND {JAN20}", start_ms=JAN10, end_ms=JAN20, date_negated=True)
hard("filter_media_type", "media_type = 5", media_type=5)
hard("filter_media_type_negated", "media_type <> 5", media_type=5, type_negated=True)
hard("filter_geo_box", IN_BOX, box=BOX)
hard("filter_geo_box_negated", f"NOT {IN_BOX}", box=BOX, geo_negated=True)
hard("filter_country_suffix", "coalesce(lower(location_name) LIKE '%, c2', false)", country="c2")
hard("filter_country_suffix_negated", "NOT coalesce(lower(location_name) LIKE '%, c2', false)", country="C2", country_negated=True)
hard("filter_person_exists", f"{has_person(1)} AND NOT {has_person(2)}", persons=((1, False), (2, True)))
hard("filter_text_like", "(lower(file_name) LIKE '%g\\_1%' ESCAPE '\\' OR coalesce(lower(relative_path) LIKE '%g\\_1%' ESCAPE '\\', false))", text="G_1")

ORDER = "ORDER BY date_taken DESC NULLS LAST, id"
register("all_photos_summary", lambda g: ph.summaries(g.photos, False), f"SELECT {S} FROM photos")
register("visible_photos_summary", lambda g: ph.summaries(g.photos), f"SELECT {S} FROM photos WHERE NOT is_hidden")
register("visible_photos_paged", lambda g: ph.page(g.photos, 2), f"SELECT {S} FROM photos WHERE NOT is_hidden {ORDER} LIMIT 80 OFFSET 200")
register("visible_photos_keyset", lambda g: ph.page_after(g.photos, JAN20, 10), f"SELECT {S} FROM photos WHERE NOT is_hidden AND (date_taken < {JAN20} OR date_taken IS NULL OR (date_taken = {JAN20} AND id > 10)) {ORDER} LIMIT 80")
register(
    "timeline_order",
    lambda g: global_rank(g.photos.filter(ph.visible()).select("id", "date_taken"), ph.newest_first()).select("id", "rank"),
    f"SELECT id, row_number() OVER ({ORDER}) AS rank FROM photos WHERE NOT is_hidden",
)
register("photos_by_ids", lambda g: ph.with_ids(g.photos, [3, 1, 99999999, 8]).select(*ph.SUMMARY), f"SELECT {S} FROM photos WHERE id IN (3, 1, 99999999, 8)")
register("photos_by_id_table", lambda g: ph.with_ids(g.photos, g.faces.select("photo_id")).select(*ph.SUMMARY), f"SELECT {S} FROM photos WHERE id IN (SELECT photo_id FROM faces)", "photos faces")
register("exclude_ids", lambda g: ph.with_ids(g.photos, [], negate=True).select("id"), "SELECT id FROM photos")
register(
    "reorder_by_ids",
    lambda g: ph.reorder_by_ids(g.photos.select("id", "file_name"), g.spark.sql("SELECT posexplode(array(3L, 1L, 99999999L, 2L, 3L)) AS (pos, id)")).select(F.col("pos").cast("long").alias("pos"), "id", "file_name"),
    "SELECT CAST(p.pos AS BIGINT) AS pos, CAST(p.id AS BIGINT) AS id, f.file_name FROM (VALUES (0, 3), (1, 1), (2, 99999999), (3, 2), (4, 3)) p(pos, id) JOIN photos f ON f.id = p.id",
)
register("paths_and_sizes", lambda g: g.photos.select("id", "file_path", "file_size", "file_last_modified"), "SELECT id, file_path, file_size, file_last_modified FROM photos")
register("content_uri_for", lambda g: g.photos.select("id", F.concat(F.lit("content://media/external/images/media/"), F.col("id").cast("string")).alias("uri")), "SELECT id, concat('content://media/external/images/media/', CAST(id AS VARCHAR)) AS uri FROM photos")
register("photos_by_folder", lambda g: ph.summaries(g.photos.filter("relative_path = 'DCIM/src3'")), f"SELECT {S} FROM photos WHERE NOT is_hidden AND relative_path = 'DCIM/src3'")
register("photos_by_person", lambda g: ph.photos_by_person(g.photos, g.faces, 4), f"SELECT {S} FROM photos WHERE NOT is_hidden AND {has_person(4)}", "photos faces")
register("photo_by_id", lambda g: g.photos.filter("id = 7").select(*ph.SUMMARY), f"SELECT {S} FROM photos WHERE id = 7")
register("photo_counts", lambda g: ph.photo_counts(g.photos), "SELECT count(*) AS photo_count, count(*) FILTER (NOT is_hidden) AS visible_photo_count FROM photos")
register("photo_count", lambda g: g.photos.agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM photos")
register("visible_photo_count", lambda g: g.photos.agg(F.count_if(ph.visible()).alias("n")), "SELECT count(*) AS n FROM photos WHERE NOT is_hidden")
register("list_image_folders", lambda g: g.photos.groupBy("folder_path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "folder_path"), "SELECT folder_path, count(*) AS n FROM photos GROUP BY folder_path")
register("group_count_by_folder", lambda g: g.photos.filter(ph.visible()).groupBy("relative_path").agg(F.count("*").alias("n")), "SELECT relative_path, count(*) AS n FROM photos WHERE NOT is_hidden GROUP BY relative_path")
FOLDERS = """SELECT relative_path AS folder_path, count(*) AS photo_count,
    arg_max(file_path, {'d': coalesce(date_taken, -1), 'i': -id}) AS cover_path
    FROM photos WHERE NOT is_hidden AND relative_path IS NOT NULL GROUP BY relative_path"""
register("folder_albums", lambda g: ph.folder_albums(g.photos), FOLDERS)
register("top1_per_group", lambda g: g.photos.filter("relative_path is not null").withColumn("k", F.row_number().over(W.partitionBy("relative_path").orderBy(*ph.newest_first()))).filter("k = 1").select("relative_path", "id"), f"SELECT relative_path, id FROM (SELECT *, row_number() OVER (PARTITION BY relative_path {ORDER}) AS k FROM photos WHERE relative_path IS NOT NULL) x WHERE k = 1")
register("distinct_folders", lambda g: g.photos.filter("relative_path is not null").select("relative_path").distinct(), "SELECT DISTINCT relative_path FROM photos WHERE relative_path IS NOT NULL")
register("distinct_locations", lambda g: g.photos.filter(ph.visible() & F.col("location_name").isNotNull()).select("location_name").distinct(), "SELECT DISTINCT location_name FROM photos WHERE NOT is_hidden AND location_name IS NOT NULL")
register("photos_needing_metadata", lambda g: g.photos.filter(~F.col("is_metadata_extracted")).select("id"), "SELECT id FROM photos WHERE NOT is_metadata_extracted")
register(
    "missing_analysis",
    lambda g: ph.missing_analysis(g.photos, g.analyses, "clip_embedding", "m1").orderBy("id").limit(500).select("id", "file_path"),
    "SELECT id, file_path FROM photos p WHERE NOT is_hidden AND NOT EXISTS (SELECT 1 FROM photo_analyses a WHERE a.photo_id = p.id AND a.analysis_type = 'clip_embedding' AND a.model_name = 'm1') ORDER BY id LIMIT 500",
    "photos photo_analyses",
)
register(
    "count_missing_analysis",
    lambda g: ph.missing_analysis(g.photos, g.analyses, "clip_embedding", "m1").agg(F.count("*").alias("n")),
    "SELECT count(*) AS n FROM photos p WHERE NOT is_hidden AND NOT EXISTS (SELECT 1 FROM photo_analyses a WHERE a.photo_id = p.id AND a.analysis_type = 'clip_embedding' AND a.model_name = 'm1')",
    "photos photo_analyses",
)
register("escape_like", lambda g: g.photos.filter(F.col("file_name").like("%" + escape_like("G_1") + "%")).select("id"), "SELECT id FROM photos WHERE file_name LIKE '%G\\_1%' ESCAPE '\\'")

# ---- dates and timeline
register("resolve_date_taken", lambda g: g.photos.select("id", tl.resolve_date_taken(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("date_taken")), F.col("file_last_modified")).alias("d")), "SELECT id, CASE WHEN (CASE WHEN id % 3 = 0 THEN 0 ELSE date_taken END) > 0 THEN date_taken ELSE file_last_modified END AS d FROM photos")
register("date_range_ms", lambda g: g.photos.filter(F.col("date_taken").between(*tl.date_range_ms(datetime(2024, 1, 10).date(), datetime(2024, 1, 19).date()))).select("id"), f"SELECT id FROM photos WHERE date_taken BETWEEN {JAN10} AND {JAN20}")
T = tl.thresholds(NOW)
BUCKET = f"""CASE WHEN date_taken IS NULL THEN NULL WHEN date_taken >= {T['today']} THEN 'Today' WHEN date_taken >= {T['week']} THEN 'This week'
    WHEN date_taken >= {T['month']} THEN 'This month' WHEN date_taken >= {T['year']} THEN strftime(make_timestamp(date_taken * 1000), '%B')
    ELSE strftime(make_timestamp(date_taken * 1000), '%B %Y') END"""
register("timeline_bucket", lambda g: g.photos.select("id", tl.timeline_bucket(F.col("date_taken"), NOW).alias("bucket")), f"SELECT id, {BUCKET} AS bucket FROM photos")
LATER = datetime(2025, 3, 5, tzinfo=UTC)
register("timeline_bucket_past_year", lambda g: g.photos.select("id", tl.timeline_bucket(F.col("date_taken"), LATER).alias("bucket")), "SELECT id, CASE WHEN date_taken IS NOT NULL THEN strftime(make_timestamp(date_taken * 1000), '%B %Y') END AS bucket FROM photos")
register(
    "timeline_headers",
    lambda g: tl.timeline_headers(g.photos.filter(ph.visible()), tl.timeline_bucket(F.col("date_taken"), NOW)).select("id", "header"),
    f"WITH b AS (SELECT id, date_taken, {BUCKET} AS bucket FROM photos WHERE NOT is_hidden) SELECT id, CASE WHEN bucket IS DISTINCT FROM lag(bucket) OVER ({ORDER}) THEN bucket END AS header FROM b",
)
register(
    "viewer_index",
    lambda g: tl.viewer_index(g.photos.filter(ph.visible()), 42),
    f"SELECT coalesce((SELECT k FROM (SELECT id, row_number() OVER ({ORDER}) - 1 AS k FROM photos WHERE NOT is_hidden) x WHERE id = 42), 0) AS start_index",
)
