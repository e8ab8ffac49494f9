"""Syncs, batch steps and whole scans that run on tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import mutate, people
from ..operators import photos as ph
from ..shared import shared_dir
from ..sources import geonames, media
from ..streaming import sync
from . import register

#: Photo columns that a scan reads and writes.
PHOTO = (
    "id", "file_path", "file_name", "folder_path", "file_size", "file_last_modified", "width", "height", "latitude", "longitude", "location_name",
    "camera_make", "camera_model", "orientation", "media_type", "is_hidden", "is_metadata_extracted",
)
FACE = ("id", "photo_id", "person_id", "embedding", "assignment_type", "confidence", "box_left", "box_top", "box_right", "box_bottom")


def written(g, buckets: int = 0):
    """The gallery's tables in a folder of their own, as a sync expects them."""
    folder = f"{shared_dir(g.spark)}/library-{uuid.uuid4().hex}"
    tables = sync.Tables(f"{folder}/photos", f"{folder}/analyses", f"{folder}/faces", buckets)
    tables.write(g.photos.select(*PHOTO), tables.photos, "id")
    tables.write(g.analyses, tables.analyses, "photo_id")
    tables.write(g.faces.select(*FACE), tables.faces, "photo_id")
    return tables


def listing(g):
    """The device's listing as photo rows, some of them twice: the older state of a photo must not win."""
    kinds = dict(g.photos.dtypes)
    rows = g.live.withColumns({"file_name": F.concat(F.lit("IMG_"), F.col("id").cast("string"), F.lit(".jpg")), "folder_path": F.lit(""), "is_hidden": F.lit(False), "is_metadata_extracted": F.lit(False), "orientation": F.lit(0), "media_type": F.lit(0)})
    for c in PHOTO:
        rows = rows.withColumn(c, (F.col(c) if c in rows.columns else F.lit(None)).cast(kinds[c]))
    stale = rows.withColumn("file_last_modified", F.col("file_last_modified") - 5).withColumn("file_size", F.lit(1).cast("long"))
    return rows.select(*PHOTO).unionByName(stale.select(*PHOTO))


def synced(g, buckets: int = 0):
    tables = written(g, buckets)
    sync.sync(listing(g), g.live.select("file_path"), tables)
    return tables


#: Photos that lose what hangs on them: gone by path and by id, under another id, or changed.
GONE = """gone AS (SELECT p.id FROM photos p LEFT JOIN live_media l ON l.file_path = p.file_path
    WHERE CASE WHEN l.id IS NULL THEN p.id NOT IN (SELECT id FROM live_media) ELSE l.id <> p.id OR l.file_size <> p.file_size OR l.file_last_modified <> p.file_last_modified END)"""
read = lambda g, path: g.spark.read.parquet(path)
register("sync_photos", lambda g: read(g, synced(g).photos).select("id", "file_path", "file_size", "file_last_modified"), "SELECT id, file_path, file_size, file_last_modified FROM live_media", "photos live_media")
register("sync_photos_children", lambda g: read(g, synced(g, 4).faces).select("id", "photo_id"), f"WITH {GONE} SELECT id, photo_id FROM faces WHERE photo_id NOT IN (SELECT id FROM gone)", "photos live_media faces")


def discovered(g):
    """A discovery whose first try is stopped between the two renames of a table; the next one recovers it."""
    tables, tries = written(g), []

    def step() -> None:
        if not tries:
            tries.append(1)
            fs, _, old, now = mutate.places(g.spark, tables.photos)
            fs.rename(now, old)
            raise OSError("stopped")
        sync.sync(listing(g), None, tables)

    sync.run_scan({"discovery": step})
    return read(g, tables.photos).select("id", "file_path", "file_size")


register(
    "discovery_run", discovered,
    f"WITH {GONE}, kept AS (SELECT p.id, p.file_path, p.file_size FROM photos p WHERE p.file_path NOT IN (SELECT file_path FROM live_media) AND p.id NOT IN (SELECT id FROM live_media)) SELECT id, file_path, file_size FROM live_media UNION ALL SELECT * FROM kept",
    "photos live_media",
)


# ---- batches


def decoder():
    """A decoder that fails for paths that end in 6 and finds positions for the others."""

    def decode(path: str) -> dict:
        if path.endswith("6"):
            raise OSError("broken")
        n = int(path.rsplit("/", 1)[1])
        return {"latitude": float(n % 24), "longitude": float(n % 24) * 2, "camera_make": " M ", "camera_model": "Front", "orientation": 90}

    return decode


EXIF = """read AS (SELECT id FROM photos WHERE NOT is_metadata_extracted AND id % 10 <> 6),
    place AS (SELECT id, CASE WHEN id % 24 <> 0 THEN id % 24 END AS n FROM read)"""
#: Nation n lies at n, 2n; some have no city, and then another city may be near.
register(
    "metadata_batch",
    lambda g: media.metadata_batch(g.photos.select(*PHOTO), g.cities.filter("id >= 1000000"), decoder).select("id", "latitude", "longitude", "camera_make", "orientation", "location_name", "media_type", "is_metadata_extracted"),
    f"""WITH {EXIF}, c AS (SELECT * FROM cities WHERE id >= 1000000),
        near AS (SELECT p.id, c.name || ', ' || c.country_code AS label, row_number() OVER (PARTITION BY p.id ORDER BY (c.latitude - n) ** 2 + (c.longitude - 2 * n) ** 2, c.id) AS k
                 FROM place p JOIN c ON abs(c.latitude - n) <= 1 AND abs(c.longitude - 2 * n) <= 1)
        SELECT p.id, CASE WHEN r.id IS NOT NULL THEN CAST(l.n AS DOUBLE) ELSE p.latitude END AS latitude, CASE WHEN r.id IS NOT NULL THEN CAST(l.n * 2 AS DOUBLE) ELSE p.longitude END AS longitude,
          CASE WHEN r.id IS NOT NULL THEN 'M' ELSE p.camera_make END AS camera_make, CASE WHEN r.id IS NOT NULL THEN 90 ELSE p.orientation END AS orientation, coalesce(near.label, p.location_name) AS location_name,
          CASE WHEN r.id IS NULL THEN p.media_type WHEN p.width > 0 AND p.height > 0 THEN CASE WHEN greatest(p.width / p.height, p.height / p.width) > 2.2 THEN 3 WHEN p.width = p.height THEN 8 ELSE 2 END ELSE 1 END AS media_type,
          p.is_metadata_extracted OR r.id IS NOT NULL AS is_metadata_extracted
        FROM photos p LEFT JOIN read r ON r.id = p.id LEFT JOIN place l ON l.id = p.id LEFT JOIN near ON near.id = p.id AND near.k = 1""",
    "photos cities",
)
register("extract_metadata", lambda g: media.metadata_update(g.photos, g.photos.filter("not is_metadata_extracted").select("id", F.lit(0.0).alias("latitude"), F.lit(0.0).alias("longitude"), F.lit(" M ").alias("camera_make"), F.lit("x").alias("camera_model"), F.lit(90).alias("orientation"), (F.col("id") % 8 == 0).alias("failed"))).select("id", "latitude", "camera_make", "orientation", "is_metadata_extracted"), "SELECT id, CASE WHEN NOT is_metadata_extracted AND id % 8 <> 0 THEN NULL ELSE latitude END AS latitude, CASE WHEN is_metadata_extracted THEN camera_make WHEN id % 8 <> 0 THEN 'M' END AS camera_make, CASE WHEN NOT is_metadata_extracted AND id % 8 <> 0 THEN 90 ELSE orientation END AS orientation, true AS is_metadata_extracted FROM photos")


def detector():
    """Finds as many faces as the path's last digit says, at most 4, and fails at 7."""

    def find(path: str) -> list[dict]:
        n = int(path[-1])
        if n == 7:
            raise OSError("broken")
        return [{"box_left": k / 10, "box_top": 0.1, "box_right": k / 10 + 0.1, "box_bottom": 0.3, "confidence": 0.5 + k / 10, "embedding": [float(k), 1.0]} for k in range(min(n, 4))]

    return find


def faced(g, analyses=None, faces=None):
    photos = g.photos.select(*PHOTO)
    return sync.index_faces(photos, g.analyses if analyses is None else analyses, (g.faces if faces is None else faces).select(*FACE), "d_e", detector, 5)


SEEN = "seen AS (SELECT id, id % 10 AS n FROM photos WHERE NOT is_hidden)"
FOUND = "found AS (SELECT id, unnest(range(0, least(n, 4))) AS k FROM seen WHERE n <> 7)"
register(
    "face_index_batch", lambda g: faced(g)[0].filter("analysis_type = 'faces'").select("photo_id", "model_name", "text_result"),
    f"WITH {SEEN} SELECT id AS photo_id, 'd_e' AS model_name, CASE WHEN n = 7 THEN 'error: broken' ELSE CAST(least(n, 4) AS VARCHAR) END AS text_result FROM seen",
)
register(
    "face_index_faces", lambda g: faced(g)[1].select("id", "photo_id", "person_id", F.round("confidence", 6).alias("confidence")),
    f"""WITH {SEEN}, {FOUND}, top AS (SELECT max(id) AS t FROM faces)
        SELECT id, photo_id, person_id, round(confidence, 6) AS confidence FROM faces WHERE photo_id NOT IN (SELECT id FROM seen WHERE n <> 7)
        UNION ALL SELECT t + row_number() OVER (ORDER BY id, k), id, NULL, round(0.5 + k / 10.0::DOUBLE, 6) FROM found, top""",
    "photos faces",
)


def reanalysed(g):
    """Faces and their analyses gone, then a run over every visible photo again."""
    before, faces = faced(g)
    _, empty = people.reset_face_data(g.persons.withColumn("centroid_embedding", F.lit(None).cast("array<double>")), faces)
    analyses, again = faced(g, sync.reindex(before, "faces"), empty)
    left = ph.missing_analysis(g.photos, analyses, "faces", "d_e").agg(F.count("*").alias("left"))
    return again.groupBy("photo_id").agg(F.count("*").alias("n")).crossJoin(F.broadcast(left))


register("face_reanalysis", reanalysed, f"WITH {SEEN}, {FOUND} SELECT id AS photo_id, count(*) AS n, CAST(0 AS BIGINT) AS \"left\" FROM found GROUP BY id")


# ---- whole scans


def scanned(g, order):
    """(k, step, rows): the steps of a scan in the order in which they ran, each with the rows it left."""
    spark, tables, log = g.spark, written(g), []
    persons = f"{tables.photos}-persons"
    g.persons.write.parquet(persons)

    def step(name, action, path, condition="true"):
        def run() -> None:
            action()
            log.append((len(log), name, read(g, path).filter(condition).count()))

        return run

    def encoder():
        return lambda path: [float(len(path)), 1.0]

    def discovery() -> None:
        sync.sync(listing(g), g.live.select("file_path"), tables)

    def cities() -> None:
        geonames.import_cities(g.cities, g.aliases, f"{tables.photos}-places", "1")

    def metadata() -> None:
        mutate.swap(media.metadata_batch(read(g, tables.photos), g.cities, decoder), tables.photos)

    def clip() -> None:
        old = read(g, tables.analyses)
        new = sync.run_analysis(read(g, tables.photos), old, "clip_embedding", "m1", encoder, 5)
        mutate.swap(mutate.upsert(old, new, ["photo_id", "analysis_type", "model_name"]), tables.analyses)

    def faces() -> None:
        analyses, found = sync.index_faces(read(g, tables.photos), read(g, tables.analyses), read(g, tables.faces), "d_e", detector, 5)
        mutate.swap(found, tables.faces)
        mutate.swap(analyses, tables.analyses)

    def cleanup() -> None:
        mutate.swap(mutate.cleanup(read(g, persons), read(g, tables.faces)), persons)

    steps = {
        "discovery": step("discovery", discovery, tables.photos),
        "cities": step("cities", cities, f"{tables.photos}-places/cities"),
        "metadata": step("metadata", metadata, tables.photos, "is_metadata_extracted"),
        "clip": step("clip", clip, tables.analyses, "analysis_type = 'clip_embedding'"),
        "faces": step("faces", faces, tables.faces),
        "cleanup": step("cleanup", cleanup, persons),
    }
    done = sync.run_scan(steps, order)
    return spark.createDataFrame([(k, s, n) for k, s, n in log if s in done], "k long, step string, n long")


SCAN = f"""WITH {GONE}, now AS (SELECT l.id, l.file_path, coalesce(p.is_hidden, false) AS hidden, coalesce(p.is_metadata_extracted, false) AS read FROM live_media l
      LEFT JOIN photos p ON p.id = l.id AND p.file_path = l.file_path AND p.file_size = l.file_size AND p.file_last_modified = l.file_last_modified),
    a AS (SELECT photo_id FROM photo_analyses WHERE photo_id NOT IN (SELECT id FROM gone)),
    f AS (SELECT id, photo_id, person_id, assignment_type FROM faces WHERE photo_id NOT IN (SELECT id FROM gone)),
    seen AS (SELECT id, CAST(right(file_path, 1) AS INT) AS n FROM now WHERE NOT hidden),
    old AS (SELECT * FROM f WHERE photo_id NOT IN (SELECT id FROM seen WHERE n <> 7)),
    c AS (SELECT p.id, p.name, (SELECT count(DISTINCT photo_id) FROM old WHERE old.person_id = p.id AND assignment_type IN ('auto', 'manual')) AS n FROM persons p),
    s AS (SELECT 'discovery' AS step, (SELECT count(*) FROM now) AS n
      UNION ALL SELECT 'cities', (SELECT count(*) FROM cities)
      UNION ALL SELECT 'metadata', (SELECT count(*) FROM now WHERE read OR right(file_path, 1) <> '6')
      UNION ALL SELECT 'clip', (SELECT count(*) FROM a) + (SELECT count(*) FROM now WHERE NOT hidden AND id NOT IN (SELECT photo_id FROM a))
      UNION ALL SELECT 'faces', (SELECT count(*) FROM old) + (SELECT sum(least(n, 4)) FROM seen WHERE n <> 7)
      UNION ALL SELECT 'cleanup', (SELECT count(*) FROM c WHERE NOT (n = 0 AND name IS NULL)))
    SELECT CAST(row_number() OVER (ORDER BY list_position(o, step)) - 1 AS BIGINT) AS k, step, CAST(n AS BIGINT) AS n FROM s, (SELECT {{order}} AS o) WHERE list_position(o, step) > 0"""
USES = "photos live_media photo_analyses faces persons cities"
register("full_scan_dag", lambda g: scanned(g, sync.FULL_SCAN), SCAN.format(order="['discovery', 'cities', 'metadata', 'clip', 'ai', 'faces', 'cleanup']"), USES)
register("gallery_scan_dag", lambda g: scanned(g, sync.GALLERY_SCAN), SCAN.format(order="['discovery', 'metadata', 'clip', 'faces', 'cleanup']"), USES)
