"""Tables of a photo library: explicit schemas, keys and closed vocabularies."""

from __future__ import annotations

from pyspark.sql.types import StructType

#: DDL of each table.
TABLES: dict[str, str] = {
    "photos": "id long not null, file_path string not null, file_name string not null, file_last_modified long not null, folder_path string not null, relative_path string, date_taken long, date_added long not null, width int, height int, orientation int, latitude double, longitude double, location_name string, camera_make string, camera_model string, file_size long, mime_type string, media_type int not null, is_favorite boolean not null, is_hidden boolean not null, is_metadata_extracted boolean not null, quality_score float, is_blurry boolean not null",
    "photo_analyses": "photo_id long not null, analysis_type string not null, model_name string not null, text_result string, embedding array<float>, embedding_dim int, created_at long not null, duration_ms long",
    "persons": "id long not null, name string, created_at long not null, photo_count int not null, is_hidden boolean not null, centroid_embedding array<float>, centroid_updated_at long",
    "faces": "id long not null, photo_id long not null, person_id long, box_left float not null, box_top float not null, box_right float not null, box_bottom float not null, embedding array<float>, embedding_model string, confidence float, is_primary boolean not null, assignment_type string, exclusion_reason string, assignment_confidence float, assigned_at long, weight float not null",
    "albums": "id long not null, name string not null, album_type string not null, folder_path string, cover_photo_id long, photo_count int not null, created_at long not null, auto_criteria_json string",
    "album_photos": "album_id long not null, photo_id long not null, added_at long not null",
    "ai_models": "id long not null, model_type string not null, model_name string not null, model_path string, model_size long, is_active boolean not null, is_builtin boolean not null, config_json string, added_at long not null",
    "photo_hashes": "photo_id long not null, phash string, dhash string, file_hash string",
    "cities": "id long not null, name string not null, country_code string not null, latitude double not null, longitude double not null, population int",
    "city_aliases": "city_id long not null, alias string not null",
    "analysis_log": "id long not null, photo_id long not null, analysis_type string not null, model_used string, started_at long not null, completed_at long, success boolean, error_message string",
}


def schema(name: str) -> StructType:
    """A table's schema; needs a running Spark application to parse it."""
    return StructType.fromDDL(TABLES[name])

KEYS: dict[str, list[str]] = {
    "photos": ["id"], "photo_analyses": ["photo_id", "analysis_type", "model_name"], "persons": ["id"], "faces": ["id"],
    "albums": ["id"], "album_photos": ["album_id", "photo_id"], "ai_models": ["id"], "photo_hashes": ["photo_id"],
    "cities": ["id"], "city_aliases": ["city_id", "alias"], "analysis_log": ["id"],
}

#: Media types by number.
OTHER, PHOTO, SELFIE, PANORAMA, BURST, SCREENSHOT, DOCUMENT, SOCIAL, SQUARE = range(9)
COMMITTED = ("auto", "manual")
ASSIGNMENTS = ("auto", "pending", "manual", "ignored")
EXCLUSIONS = ("irrelevant", "not_a_person", "depiction", "low_quality")
SUMMARY = ["id", "file_path", "file_name", "date_added", "date_taken", "is_favorite"]
