"""Tables after mutations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import albums as al
from ..operators import mutate as mu
from ..operators import people as pe
from . import register

P = "id, file_name, file_size"
NEW = "SELECT id + CASE WHEN id % 2 = 0 THEN 0 ELSE 7000000 END AS id, 'new.jpg' AS file_name, CAST(1 AS BIGINT) AS file_size FROM photos"
#: Every key of the batch comes twice.
LAST = f"SELECT id, 'newer.jpg' AS file_name, file_size + 1 AS file_size FROM ({NEW}) x"


def base(g):
    return g.photos.select("id", "file_name", "file_size")


def twice(g):
    """The batch with every key once more, later."""
    return incoming(g).unionByName(incoming(g).withColumn("file_name", F.lit("newer.jpg")).withColumn("file_size", F.col("file_size") + 1))


def incoming(g):
    return g.photos.select((F.col("id") + F.when(F.col("id") % 2 == 0, 0).otherwise(7000000)).cast("long").alias("id"), F.lit("new.jpg").alias("file_name"), F.lit(1).cast("long").alias("file_size"))


UPSERT = f"WITH n AS ({LAST}) SELECT {P} FROM photos WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT {P} FROM n"
register("upsert_photos", lambda g: mu.upsert(base(g), twice(g), ["id"], ["file_size"]), UPSERT)
register("insert_replace", lambda g: mu.insert_replace(base(g), twice(g), ["id"], ["file_size"]), UPSERT)
register("insert_ignore", lambda g: mu.insert_ignore(base(g), twice(g), ["id"], ["file_size"]), f"WITH n AS ({NEW}) SELECT {P} FROM photos UNION ALL SELECT {P} FROM n WHERE id NOT IN (SELECT id FROM photos)")
register("insert_abort", lambda g: mu.insert_abort(base(g), incoming(g).filter("id >= 7000000"), ["id"]), f"WITH n AS ({NEW}) SELECT {P} FROM photos UNION ALL SELECT {P} FROM n WHERE id >= 7000000")
K = ["photo_id", "analysis_type", "model_name"]
register("upsert_analyses", lambda g: mu.upsert(g.analyses.select(*K, "text_result"), g.photos.select(F.col("id").alias("photo_id"), F.lit("clip_embedding").alias("analysis_type"), F.lit("m1").alias("model_name"), F.explode(F.array(F.lit("t"), F.lit("a"))).alias("text_result")), K, ["text_result"]), "SELECT photo_id, analysis_type, model_name, text_result FROM photo_analyses WHERE photo_id NOT IN (SELECT id FROM photos) UNION ALL SELECT id, 'clip_embedding', 'm1', 't' FROM photos", "photos photo_analyses")
register("delete_by_uris", lambda g: mu.delete_keys(base(g).join(g.photos.select("id", "file_path"), "id"), g.live.select("file_path"), ["file_path"]).select("id"), "SELECT id FROM photos WHERE file_path NOT IN (SELECT file_path FROM live_media)", "photos live_media")


def cascade(g, name):
    tables = {"photos": g.photos, "photo_analyses": g.analyses, "faces": g.faces, "album_photos": g.album_photos, "photo_hashes": g.hashes, "analysis_log": g.log, "albums": g.albums}
    return mu.delete_photos(tables, g.photos.filter("id % 3 = 0").select("id"))[name]


GONE = "(SELECT id FROM photos WHERE id % 3 = 0)"
register("cascade_delete_photo", lambda g: cascade(g, "faces").select("id", "photo_id"), f"SELECT id, photo_id FROM faces WHERE photo_id NOT IN {GONE}", "faces photos")
register("cascade_delete_album_photos", lambda g: cascade(g, "album_photos").select("album_id", "photo_id"), f"SELECT album_id, photo_id FROM album_photos WHERE photo_id NOT IN {GONE}", "album_photos photos")
register("cascade_delete_analyses", lambda g: cascade(g, "photo_analyses").select("photo_id"), f"SELECT photo_id FROM photo_analyses WHERE photo_id NOT IN {GONE}", "photo_analyses photos")
register("cascade_delete_log", lambda g: cascade(g, "analysis_log").select("id"), f"SELECT id FROM analysis_log WHERE photo_id NOT IN {GONE}", "analysis_log photos")
register("cascade_null_album_cover", lambda g: cascade(g, "albums").select("id", "cover_photo_id"), f"SELECT id, CASE WHEN cover_photo_id IN {GONE} THEN NULL ELSE cover_photo_id END AS cover_photo_id FROM albums", "albums photos")
F1 = "id, person_id, assignment_type"
pf = lambda tables: tables[1].select("id", "person_id", "assignment_type")
register("delete_person_set_null", lambda g: pf(mu.delete_person(g.persons, g.faces, 4)), "SELECT id, CASE WHEN person_id = 4 THEN NULL ELSE person_id END AS person_id, assignment_type FROM faces", "faces")
register("update_predicate", lambda g: mu.update_where(base(g), F.col("id") % 5 == 0, {"file_size": F.col("file_size") * 2}), "SELECT id, file_name, CASE WHEN id % 5 = 0 THEN file_size * 2 ELSE file_size END AS file_size FROM photos")
COUNT = "(SELECT count(DISTINCT photo_id) FROM faces f WHERE f.person_id = p.id AND f.assignment_type IN ('auto', 'manual'))"
register("recalc_person_counts", lambda g: mu.recalc_person_counts(g.persons, g.faces).select("id", "photo_count"), f"SELECT id, CAST({COUNT} AS INT) AS photo_count FROM persons p", "persons faces")
register("recalc_album_counts", lambda g: mu.recalc_album_counts(g.albums, g.album_photos).select("id", "photo_count"), "SELECT id, CAST((SELECT count(*) FROM album_photos x WHERE x.album_id = a.id) AS INT) AS photo_count FROM albums a", "albums album_photos")
register("delete_empty_unnamed", lambda g: mu.delete_empty_unnamed(g.persons).select("id"), "SELECT id FROM persons WHERE NOT (photo_count = 0 AND name IS NULL)", "persons")
register("cleanup", lambda g: mu.cleanup(g.persons, g.faces.filter("person_id <> 3")).select("id", "photo_count"), f"WITH c AS (SELECT id, name, CAST(CASE WHEN id = 3 THEN 0 ELSE {COUNT} END AS INT) AS photo_count FROM persons p) SELECT id, photo_count FROM c WHERE NOT (photo_count = 0 AND name IS NULL)", "persons faces")
register("activate_model_exclusive", lambda g: mu.activate_model(g.models, 7).select("id", "is_active"), "SELECT id, CASE WHEN model_type = (SELECT model_type FROM ai_models WHERE id = 7) THEN id = 7 ELSE is_active END AS is_active FROM ai_models", "ai_models")
register("log_complete", lambda g: mu.update_where(g.log, F.col("id") == 14, {"completed_at": F.lit(5), "success": F.lit(True)}).select("id", "completed_at", "success"), "SELECT id, CASE WHEN id = 14 THEN 5 ELSE completed_at END AS completed_at, CASE WHEN id = 14 THEN true ELSE success END AS success FROM analysis_log", "analysis_log")
register("delete_old_logs", lambda g: mu.delete_where(g.log, F.col("started_at") < 1705000000000).select("id"), "SELECT id FROM analysis_log WHERE started_at >= 1705000000000", "analysis_log")

# ---- people
register("mark_ignored", lambda g: pf(pe.mark_ignored(g.persons, g.faces, 8, "depiction", 5)), "SELECT id, CASE WHEN id = 8 THEN NULL ELSE person_id END AS person_id, CASE WHEN id = 8 THEN 'ignored' ELSE assignment_type END AS assignment_type FROM faces", "faces")
register("exclude_person", lambda g: pf(pe.exclude_person(g.persons, g.faces, 4, "irrelevant", 5)), "SELECT id, CASE WHEN person_id = 4 THEN NULL ELSE person_id END AS person_id, CASE WHEN person_id = 4 THEN 'ignored' ELSE assignment_type END AS assignment_type FROM faces", "faces")
register("delete_person_reset_faces", lambda g: pf(pe.delete_person_reset_faces(g.persons, g.faces, 4)), "SELECT id, CASE WHEN person_id = 4 THEN NULL ELSE person_id END AS person_id, CASE WHEN person_id = 4 THEN 'pending' ELSE assignment_type END AS assignment_type FROM faces", "faces")
register("hide_person", lambda g: pe.hide_person(g.persons, 2).select("id", "is_hidden"), "SELECT id, id = 2 OR is_hidden AS is_hidden FROM persons", "persons")
register("assign_face_write", lambda g: pf(pe.assign_face(g.persons, g.faces, 6, 2, "manual", 1.0, 1.5, 5)), "SELECT id, CASE WHEN id = 6 THEN 2 ELSE person_id END AS person_id, CASE WHEN id = 6 THEN 'manual' ELSE assignment_type END AS assignment_type FROM faces", "faces")


def with_centroids(g):
    return g.persons.withColumn("centroid_embedding", F.lit(None).cast("array<double>")).withColumn("centroid_updated_at", F.lit(None).cast("long"))


register("merge_persons", lambda g: pe.merge_persons(with_centroids(g), g.faces, 1, 3, 5)[0].select("id", "photo_count"), "WITH f AS (SELECT CASE WHEN person_id = 3 THEN 1 ELSE person_id END AS person_id, photo_id FROM faces WHERE assignment_type IN ('auto', 'manual')) SELECT id, CASE WHEN id = 1 THEN CAST((SELECT count(DISTINCT photo_id) FROM f WHERE person_id = 1) AS INT) ELSE photo_count END AS photo_count FROM persons WHERE id <> 3", "persons faces")
register("merge_persons_faces", lambda g: pf(pe.merge_persons(with_centroids(g), g.faces, 1, 3, 5)), "SELECT id, CASE WHEN person_id = 3 THEN 1 ELSE person_id END AS person_id, assignment_type FROM faces", "faces")
register("create_person", lambda g: pe.create_person(g.persons, 77, " anna  LEE", 5).select("id", "name"), "SELECT id, name FROM persons UNION ALL SELECT 77, 'Anna LEE'", "persons")
register("create_person_taken", lambda g: pe.create_person(g.persons, 77, "PERSON 4", 5).select("id", "name"), "SELECT id, name FROM persons", "persons")
register("rename_or_merge", lambda g: pe.rename_or_merge(with_centroids(g), g.faces, 3, "person 4", 5)[0].select("id"), "SELECT id FROM persons WHERE id <> 3", "persons")
register("hide_as_stranger", lambda g: pe.hide_as_stranger(with_centroids(g), g.faces, 6, 88, 5)[0].select("id", "is_hidden", "photo_count"), "SELECT id, is_hidden, photo_count FROM persons UNION ALL SELECT 88, true, 1", "persons")
register("reset_face_data", lambda g: pe.reset_face_data(with_centroids(g), g.faces)[0].select("id", "centroid_updated_at"), "SELECT id, CAST(NULL AS BIGINT) AS centroid_updated_at FROM persons", "persons")

# ---- albums
register("album_membership", lambda g: al.add_photos(g.albums, g.album_photos, g.photos.select(F.lit(7).cast("long").alias("album_id"), F.col("id").alias("photo_id"), F.lit(1).cast("long").alias("added_at")), 7)[0].select("id", "photo_count"), "SELECT id, CASE WHEN id = 7 THEN CAST((SELECT count(*) FROM (SELECT photo_id FROM album_photos WHERE album_id = 7 UNION SELECT id FROM photos) u) AS INT) ELSE photo_count END AS photo_count FROM albums", "albums album_photos photos")
register("album_remove_photo", lambda g: al.remove_photo(g.albums, g.album_photos, 7, 12)[1].select("album_id", "photo_id"), "SELECT album_id, photo_id FROM album_photos WHERE NOT (album_id = 7 AND photo_id = 12)", "album_photos")
register("album_clear", lambda g: al.clear_album(g.albums, g.album_photos, 7)[0].select("id", "photo_count"), "SELECT id, CASE WHEN id = 7 THEN 0 ELSE photo_count END AS photo_count FROM albums", "albums")
register("get_or_create_folder_album", lambda g: al.get_or_create_folder_album(g.albums, "DCIM/src5", "x", 500, 5).select("id", "folder_path"), "SELECT id, folder_path FROM albums", "albums")
register("create_album", lambda g: al.get_or_create_folder_album(g.albums, "DCIM/none", "x", 500, 5).select("id", "folder_path"), "SELECT id, folder_path FROM albums UNION ALL SELECT 500, 'DCIM/none'", "albums")
