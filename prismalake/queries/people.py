"""People queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import people as pe
from ..operators.photos import committed
from . import register

C = "assignment_type IN ('auto', 'manual')"
BEST = "ORDER BY is_primary DESC, confidence DESC NULLS LAST, id"
COVER = f"""WITH k AS (SELECT person_id, photo_id, row_number() OVER (PARTITION BY person_id {BEST}) AS k FROM faces WHERE {C}),
    b AS (SELECT person_id, max(confidence) AS best_score FROM faces GROUP BY person_id),
    pc AS (SELECT p.id, p.name, p.photo_count, p.is_hidden, f.file_path AS cover_path, b.best_score FROM persons p LEFT JOIN k ON k.person_id = p.id AND k.k = 1
           LEFT JOIN photos f ON f.id = k.photo_id LEFT JOIN b ON b.person_id = p.id WHERE NOT p.is_hidden)"""
register("people_with_cover", lambda g: pe.people_with_cover(g.persons, g.faces, g.photos), COVER + " SELECT * FROM pc", "persons faces photos")
register(
    "people_order",
    lambda g: pe.ranked_people(pe.people_with_cover(g.persons, g.faces, g.photos)).select("id", "rank"),
    COVER + " SELECT id, row_number() OVER (ORDER BY is_hidden, name IS NULL, photo_count = 0, coalesce(name IS NULL AND best_score < 0.7, false), lower(name) NULLS FIRST, photo_count DESC, id) AS rank FROM pc",
    "persons faces photos",
)
register("include_hidden_toggle", lambda g: pe.people_with_cover(g.persons, g.faces, g.photos, include_hidden=True).select("id", "is_hidden"), "SELECT id, is_hidden FROM persons", "persons")
register("max_confidence", lambda g: g.faces.groupBy("person_id").agg(F.max("confidence").alias("best_score")), "SELECT person_id, max(confidence) AS best_score FROM faces GROUP BY person_id", "faces")
register("committed_faces", lambda g: g.faces.filter(committed()).select("id", "person_id"), f"SELECT id, person_id FROM faces WHERE {C}", "faces")
register(
    "next_group_to_name",
    lambda g: pe.next_group_to_name(g.persons, g.faces, g.photos, [3]),
    f"SELECT p.id, p.photo_count, f.id AS face_id, h.file_path FROM persons p JOIN (SELECT *, row_number() OVER (PARTITION BY person_id {BEST}) AS k FROM faces) f ON f.person_id = p.id AND f.k = 1 JOIN photos h ON h.id = f.photo_id WHERE p.name IS NULL AND NOT p.is_hidden AND p.photo_count > 0 AND p.id NOT IN (3) ORDER BY p.photo_count DESC, p.id LIMIT 1",
    "persons faces photos",
)
PEND = "SELECT f.id, f.photo_id, f.person_id, p.file_path FROM faces f JOIN photos p ON p.id = f.photo_id WHERE f.assignment_type = 'pending' AND f.id NOT IN (2, 6) ORDER BY f.id LIMIT 1"
register("next_pending_face", lambda g: pe.next_pending_face(g.faces, g.photos, [2, 6]), PEND, "faces photos")
register("next_question", lambda g: pe.next_question(g.persons, g.faces, g.photos, skip_groups=range(10), skip_faces=[2, 6]), f"SELECT 'face' AS kind, id, file_path FROM ({PEND}) x", "faces photos")
register("primary_face_with_photo", lambda g: pe.primary_face_with_photo(g.faces, g.photos, 4), f"SELECT f.id, f.photo_id, p.file_path, f.confidence FROM faces f JOIN photos p ON p.id = f.photo_id WHERE f.person_id = 4 ORDER BY f.is_primary DESC, f.confidence DESC NULLS LAST, f.id LIMIT 1", "faces photos")
register("person_names_for_photo", lambda g: pe.person_names_for_photo(g.persons, g.faces, 7), f"SELECT DISTINCT p.name FROM persons p JOIN faces f ON f.person_id = p.id WHERE f.photo_id = 7 AND {C} AND p.name IS NOT NULL", "persons faces")
register("calibration_faces", lambda g: pe.calibration_faces(g.faces, g.persons).select("id", "person_id"), "SELECT f.id, f.person_id FROM faces f JOIN persons p ON p.id = f.person_id WHERE f.embedding IS NOT NULL AND NOT p.is_hidden", "faces persons")
register("labeled_faces", lambda g: pe.labeled_faces(g.faces, g.persons, g.photos), "SELECT f.id, f.person_id, p.name AS person_name, f.photo_id, h.file_path FROM faces f JOIN persons p ON p.id = f.person_id JOIN photos h ON h.id = f.photo_id", "faces persons photos")
register("person_counts", lambda g: g.persons.agg(F.count("*").alias("persons"), F.count_if(F.col("name").isNull()).alias("unnamed"), F.count_if(F.expr("name is null and not is_hidden and photo_count > 0")).alias("to_name")), "SELECT count(*) AS persons, count(*) FILTER (name IS NULL) AS unnamed, count(*) FILTER (name IS NULL AND NOT is_hidden AND photo_count > 0) AS to_name FROM persons", "persons")
register("person_count", lambda g: g.persons.agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM persons", "persons")
register("unnamed_person_count", lambda g: g.persons.agg(F.count_if(F.col("name").isNull()).alias("n")), "SELECT count(*) AS n FROM persons WHERE name IS NULL", "persons")
register("groups_to_name_count", lambda g: g.persons.agg(F.count_if(F.expr("name is null and not is_hidden and photo_count > 0")).alias("n")), "SELECT count(*) AS n FROM persons WHERE name IS NULL AND NOT is_hidden AND photo_count > 0", "persons")
register("pending_face_count", lambda g: g.faces.agg(F.count_if(F.col("assignment_type") == "pending").alias("n")), "SELECT count(*) AS n FROM faces WHERE assignment_type = 'pending'", "faces")


def queue_size(g):
    groups = g.persons.agg(F.count_if(F.expr("name is null and not is_hidden and photo_count > 0")).alias("a"))
    pending = g.faces.agg(F.count_if(F.col("assignment_type") == "pending").alias("b"))
    return groups.crossJoin(pending).select((F.col("a") + F.col("b")).alias("n"))  # two single rows


register("identification_queue_size", queue_size, "SELECT (SELECT count(*) FROM persons WHERE name IS NULL AND NOT is_hidden AND photo_count > 0) + (SELECT count(*) FROM faces WHERE assignment_type = 'pending') AS n", "persons faces")
register("count_distinct_photos", lambda g: g.faces.filter(committed()).groupBy("person_id").agg(F.countDistinct("photo_id").alias("n")), f"SELECT person_id, count(DISTINCT photo_id) AS n FROM faces WHERE {C} GROUP BY person_id", "faces")


def library_stats(g):
    photos = g.photos.agg(F.count("*").alias("photos"), F.count_if(~F.col("is_hidden")).alias("visible"))
    people = g.persons.agg(F.count("*").alias("persons"), F.count_if(F.col("name").isNull()).alias("unnamed"))
    rest = g.albums.agg(F.count("*").alias("albums")).crossJoin(g.faces.agg(F.count_if(F.col("assignment_type") == "pending").alias("pending")))
    one = photos.crossJoin(people).crossJoin(rest)  # single rows
    return one.select("*", (F.col("photos") - F.col("visible")).alias("hidden"), (F.col("persons") - F.col("unnamed")).alias("named"))


register(
    "library_stats",
    library_stats,
    """WITH s AS (SELECT (SELECT count(*) FROM photos) AS photos, (SELECT count(*) FROM photos WHERE NOT is_hidden) AS visible, (SELECT count(*) FROM persons) AS persons,
       (SELECT count(*) FROM persons WHERE name IS NULL) AS unnamed, (SELECT count(*) FROM albums) AS albums, (SELECT count(*) FROM faces WHERE assignment_type = 'pending') AS pending)
       SELECT *, photos - visible AS hidden, persons - unnamed AS named FROM s""",
    "photos persons albums faces",
)
register("known_persons", lambda g: g.persons.filter("name is not null").select("id", "name"), "SELECT id, name FROM persons WHERE name IS NOT NULL", "persons")
register("person_by_name", lambda g: pe.person_by_name(g.persons, "pERSON 4").select("id", "name"), "SELECT id, name FROM persons WHERE lower(name) = 'person 4' ORDER BY id LIMIT 1", "persons")
register("first_token_unique", lambda g: pe.first_name_unique(g.persons.withColumn("name", F.expr("case when id = 1 then 'Bob Martin' else name end"))), "WITH n AS (SELECT id, CASE WHEN id = 1 THEN 'bob' ELSE 'person' END AS first_name FROM persons WHERE name IS NOT NULL OR id = 1) SELECT first_name, min(id) AS id FROM n GROUP BY first_name HAVING count(*) = 1", "persons")
