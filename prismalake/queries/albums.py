"""Album, log, hash and model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import albums as al
from ..operators import photos as ph
from . import register
from .photos import FOLDERS

A = "id, name, album_type, photo_count"
register("photos_in_album", lambda g: al.photos_in_album(g.photos, g.album_photos, 7).select("id", "file_path"), "SELECT p.id, p.file_path FROM photos p JOIN album_photos a ON a.photo_id = p.id WHERE a.album_id = 7", "photos album_photos")
register("albums_containing_photo", lambda g: al.albums_containing_photo(g.albums, g.album_photos, 12).select("id", "name"), "SELECT a.id, a.name FROM albums a JOIN album_photos x ON x.album_id = a.id WHERE x.photo_id = 12", "albums album_photos")
for kind in ("manual", "folder", "auto"):
    cond = "album_type LIKE 'auto_%'" if kind == "auto" else f"album_type = '{kind}'"
    register(f"album_type_{kind}", lambda g, kind=kind: al.of_type(g.albums, kind).select("id", "name", "album_type", "photo_count"), f"SELECT {A} FROM albums WHERE {cond}", "albums")
register("album_type_filter", lambda g: al.of_type(g.albums, "folder").filter("folder_path = 'DCIM/src5'").orderBy("id").limit(1).select("id", "name"), "SELECT id, name FROM albums WHERE album_type = 'folder' AND folder_path = 'DCIM/src5' ORDER BY id LIMIT 1", "albums")
CARDS = "SELECT a.id, a.name, a.photo_count, p.file_path AS cover_path FROM albums a LEFT JOIN photos p ON p.id = a.cover_photo_id WHERE a.album_type LIKE 'auto_%'"
register("auto_album_cards", lambda g: al.auto_album_cards(g.albums, g.photos), CARDS, "albums photos")
register("album_list_union", lambda g: al.album_list(al.auto_album_cards(g.albums, g.photos), ph.folder_albums(g.photos)), f"WITH c AS ({CARDS}), f AS ({FOLDERS}) SELECT 0 AS section, name AS title, CAST(photo_count AS BIGINT) AS photo_count, cover_path FROM c UNION ALL SELECT 1, folder_path, photo_count, cover_path FROM f", "albums photos")
register("album_count", lambda g: g.albums.agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM albums", "albums")
register("photo_count_in_album", lambda g: g.album_photos.filter("album_id = 7").agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM album_photos WHERE album_id = 7", "album_photos")
register("is_photo_in_album", lambda g: al.is_photo_in_album(g.album_photos, 7, 12), "SELECT EXISTS (SELECT 1 FROM album_photos WHERE album_id = 7 AND photo_id = 12) AS is_in_album", "album_photos")
register("failed_logs", lambda g: g.log.filter(al.failed()).select("id", "error_message"), "SELECT id, error_message FROM analysis_log WHERE success = false", "analysis_log")
register("incomplete_logs", lambda g: g.log.filter(al.incomplete()).select("id"), "SELECT id FROM analysis_log WHERE completed_at IS NULL", "analysis_log")
register("last_log", lambda g: al.last_log(g.log), "SELECT photo_id, analysis_type, id, started_at, success FROM (SELECT *, row_number() OVER (PARTITION BY photo_id, analysis_type ORDER BY started_at DESC, id DESC) AS k FROM analysis_log) x WHERE k = 1", "analysis_log")
register("hash_lookup", lambda g: g.hashes.filter("phash = 'a1'").select("photo_id", "phash", "file_hash"), "SELECT photo_id, phash, file_hash FROM photo_hashes WHERE phash = 'a1'", "photo_hashes")
register("duplicate_hashes", lambda g: al.duplicate_hashes(g.hashes), "SELECT file_hash, count(*) AS photos, min(photo_id) AS first_photo FROM photo_hashes GROUP BY file_hash HAVING count(*) > 1", "photo_hashes")
M = "id, model_type, model_name, is_active"
register("model_list_order", lambda g: g.models.orderBy("model_type", "model_name").select("id", "model_type", "model_name", "is_active"), f"SELECT {M} FROM ai_models", "ai_models")
register("active_model", lambda g: g.models.filter("model_type = 'clip' and is_active").orderBy("id").limit(1).select("id", "model_name"), "SELECT id, model_name FROM ai_models WHERE model_type = 'clip' AND is_active ORDER BY id LIMIT 1", "ai_models")
