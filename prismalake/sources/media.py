"""Rows of a media listing: incremental scans and the shape of a photo row."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import location_label, nearest_city
from ..functions.rowwise import map_rows
from ..functions.text import detect_media_type

#: Fixed path marks, in order of precedence.
MARKS = ("/DCIM/", "/Pictures/", "/Download/", "/Documents/")


def in_folders(path: Column, folders: Iterable[str]) -> Column:
    """Below one of the folders (whole names, no patterns); without folders everywhere."""
    out = None
    for f in sorted(folders):
        below = F.coalesce(path.startswith(f.rstrip("/") + "/") | (path == f.rstrip("/")), F.lit(False))
        out = below if out is None else out | below
    return F.lit(True) if out is None else out


def scan_incremental(media: DataFrame, folders: Iterable[str] = (), since_ms: int = 0) -> DataFrame:
    """Rows changed since (seconds in ``modified_s``), below the folders, newest first."""
    out = media.filter(F.col("modified_s") > since_ms // 1000) if since_ms > 0 else media
    return out.filter(in_folders(F.col("relative_path"), folders)).orderBy(F.desc("modified_s"), "id")


def scan_since(media: DataFrame, cursors: dict[str, int]) -> DataFrame:
    """A scan with a cursor per folder, so a newly added folder (cursor 0) is read from its beginning."""
    cond = F.lit(False)
    for folder, since in sorted(cursors.items()):
        cond = cond | (in_folders(F.col("relative_path"), [folder]) & (F.col("modified_s") > since // 1000 if since > 0 else F.lit(True)))
    return media.filter(cond)


def live_paths(media: DataFrame | None, folders: Iterable[str] = ()) -> DataFrame | None:
    """Paths of all rows; None (not an empty table) if the source is unavailable."""
    return None if media is None else media.filter(in_folders(F.col("relative_path"), folders)).select("file_path").distinct()


def photo_row(media: DataFrame) -> DataFrame:
    """Listing rows as photo rows: milliseconds, folders without their last slash, dates with their fallback, sizes and media type.

    Sides of 0 and less are unknown; a listing without some of width, height,
    orientation, size_bytes and mime gives nulls for them.
    """
    folder = F.rtrim(F.col("relative_path"), F.lit("/"))
    modified = F.col("modified_s") * 1000
    has = lambda c, kind: F.col(c).cast(kind) if c in media.columns else F.lit(None).cast(kind)
    side = lambda c: F.when(has(c, "int") > 0, has(c, "int"))
    nothing = F.lit(None).cast("string")
    return media.select(
        side("width").alias("width"), side("height").alias("height"), F.coalesce(has("orientation", "int"), F.lit(0)).alias("orientation"), has("size_bytes", "long").alias("file_size"), has("mime", "string").alias("mime_type"),
        detect_media_type(F.col("file_name"), folder, side("width"), side("height"), nothing, nothing).alias("media_type"),
        "id", "file_path", "file_name", modified.alias("file_last_modified"), F.coalesce(folder, F.lit("")).alias("folder_path"), folder.alias("relative_path"),
        F.when(F.col("taken_ms") > 0, F.col("taken_ms")).otherwise(modified).alias("date_taken"), (F.col("added_s") * 1000).alias("date_added"),
        F.coalesce(F.col("favorite") == 1, F.lit(False)).alias("is_favorite"),
    )


def extract_relative_path(path: Column) -> Column:
    """Folder from the first mark that occurs on (marks in order), without the file; null without a mark."""
    out = F.lit(None).cast("string")
    for mark in reversed(MARKS):
        rest = F.substring(path, F.instr(path, mark) + 1, F.length(path))
        out = F.when(F.instr(path, mark) > 0, F.regexp_replace(rest, r"/[^/]*$", "")).otherwise(out)
    return out


EXIF = "id long, latitude double, longitude double, camera_make string, camera_model string, orientation int, failed boolean, raised boolean"


def metadata_batch(photos: DataFrame, cities: DataFrame, load: Callable[[], Callable[[str], dict]]) -> DataFrame:
    """Photos after a run over those that need metadata: decoded, named after the nearest city, and with their media type.

    ``load`` opens a decoder once a task; its callable maps a path to latitude,
    longitude, camera_make, camera_model and orientation. A row whose decoding
    raises stays as it is, so the next run tries it again.
    """
    queue = photos.filter(~F.col("is_metadata_extracted")).select("id", "file_path")

    def opened() -> Callable[[int, str], tuple]:
        decode = load()

        def one(photo: int, path: str) -> tuple:
            try:
                x = decode(path)
                return photo, x.get("latitude"), x.get("longitude"), x.get("camera_make"), x.get("camera_model"), x.get("orientation"), bool(x.get("failed")), False
            except Exception:  # retried by the next run
                return photo, None, None, None, None, None, True, True

        return one

    exif = map_rows(queue, opened, EXIF).filter(~F.col("raised")).persist()
    after = metadata_update(photos, exif)
    read = exif.select("id", F.lit(True).alias("__read"))
    after = after.join(read, "id", "left")
    near = nearest_city(after.filter("__read"), cities).select("id", location_label(F.col("city_name"), F.col("country_code")).alias("__label"))
    after = after.join(near, "id", "left")
    kind = detect_media_type(F.col("file_name"), F.col("folder_path"), F.col("width"), F.col("height"), F.col("camera_make"), F.col("camera_model"))
    new = {"location_name": F.coalesce("__label", "location_name"), "media_type": F.when(F.col("__read"), kind).otherwise(F.col("media_type")).cast("int")}
    return after.select(*(new[c].alias(c) if c in new else F.col(c) for c in photos.columns))


def metadata_update(photos: DataFrame, exif: DataFrame) -> DataFrame:
    """Photos with decoded metadata (id, latitude, longitude, make, model, orientation; ``failed``).

    A position of exactly 0, 0 is none. A failed decoding keeps position and
    orientation, loses make and model, and counts as extracted too.
    """
    e = exif.select("id", *(F.col(c).alias(f"x_{c}") for c in ("latitude", "longitude", "camera_make", "camera_model", "orientation", "failed")), F.lit(True).alias("seen"))
    none = (F.col("x_latitude") == 0) & (F.col("x_longitude") == 0)
    j = photos.join(e, "id", "left")
    bad = F.coalesce(F.col("x_failed"), F.lit(False))
    new = {
        **{c: F.when(bad, F.col(c)).when(none, None).otherwise(F.col(f"x_{c}")) for c in ("latitude", "longitude")},
        "orientation": F.when(bad, F.col("orientation")).otherwise(F.col("x_orientation")),
        **{c: F.when(~bad, F.trim(f"x_{c}")) for c in ("camera_make", "camera_model")},
        "is_metadata_extracted": F.lit(True),
    }
    return j.select(*(F.when(F.col("seen"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in photos.columns))
