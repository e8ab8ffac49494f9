"""Albums, analysis logs, hashes and model rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import mutate
from .photos import newest_first


def photos_in_album(photos: DataFrame, album_photos: DataFrame, album: int) -> DataFrame:
    """Photos of an album, hidden ones too."""
    of = album_photos.filter(F.col("album_id") == album).select(F.col("photo_id").alias("id"))
    return photos.join(of, "id").orderBy(*newest_first())


def albums_containing_photo(albums: DataFrame, album_photos: DataFrame, photo: int) -> DataFrame:
    of = album_photos.filter(F.col("photo_id") == photo).select(F.col("album_id").alias("id"))
    return albums.join(of, "id", "left_semi").orderBy("name", "id")


def of_type(albums: DataFrame, kind: str) -> DataFrame:
    """Albums of a type; ``auto`` stands for all types that begin with it and one more character (a LIKE pattern's ``_``)."""
    return albums.filter(F.col("album_type").like("auto_%") if kind == "auto" else F.col("album_type") == kind)


def auto_album_cards(albums: DataFrame, photos: DataFrame) -> DataFrame:
    """Automatic albums with the path of their cover, null if there is none."""
    covers = photos.select(F.col("id").alias("cover_photo_id"), F.col("file_path").alias("cover_path"))
    return of_type(albums, "auto").join(covers, "cover_photo_id", "left").select("id", "name", "photo_count", "cover_path").orderBy("name", "id")


def album_list(cards: DataFrame, folders: DataFrame) -> DataFrame:
    """Sections of the album screen: automatic albums, then folders: (section, title, photo_count, cover_path)."""
    auto = cards.select(F.lit(0).alias("section"), F.col("name").alias("title"), F.col("photo_count").cast("long").alias("photo_count"), "cover_path")
    return auto.unionByName(folders.select(F.lit(1).alias("section"), F.col("folder_path").alias("title"), "photo_count", "cover_path"))


def is_photo_in_album(album_photos: DataFrame, album: int, photo: int) -> DataFrame:
    return album_photos.filter((F.col("album_id") == album) & (F.col("photo_id") == photo)).agg((F.count("*") > 0).alias("is_in_album"))


def add_photos(albums: DataFrame, album_photos: DataFrame, rows: DataFrame, album: int) -> tuple[DataFrame, DataFrame]:
    """Membership with the new rows (known ones ignored) and the recounted albums."""
    members = mutate.insert_ignore(album_photos, rows.dropDuplicates(["album_id", "photo_id"]), ["album_id", "photo_id"])
    return mutate.recalc_album_counts(albums, members, album), members


def remove_photo(albums: DataFrame, album_photos: DataFrame, album: int, photo: int) -> tuple[DataFrame, DataFrame]:
    members = mutate.delete_where(album_photos, (F.col("album_id") == album) & (F.col("photo_id") == photo))
    return mutate.recalc_album_counts(albums, members, album), members


def clear_album(albums: DataFrame, album_photos: DataFrame, album: int) -> tuple[DataFrame, DataFrame]:
    return mutate.update_where(albums, F.col("id") == album, {"photo_count": F.lit(0)}), mutate.delete_where(album_photos, F.col("album_id") == album)


def get_or_create_folder_album(albums: DataFrame, path: str, name: str, new_id: int, now: int) -> DataFrame:
    """The table with a folder album for ``path``; an existing one keeps it as it is."""
    row = albums.sparkSession.range(1).select(F.lit(new_id).cast("long").alias("id"), F.lit(name).alias("name"), F.lit("folder").alias("album_type"), F.lit(path).alias("folder_path"), F.lit(0).alias("photo_count"), F.lit(now).cast("long").alias("created_at"))
    for c, kind in albums.dtypes:
        if c not in row.columns:
            row = row.withColumn(c, F.lit(None).cast(kind))
    have = albums.filter((F.col("album_type") == "folder") & (F.col("folder_path") == path)).select("folder_path")
    return albums.unionByName(row.join(have, "folder_path", "left_anti").select(*albums.columns))


def last_log(log: DataFrame) -> DataFrame:
    """The latest row of each (photo, type); the larger id on ties."""
    latest = F.max_by(F.struct("id", "started_at", "success"), F.struct("started_at", "id")).alias("l")
    return log.groupBy("photo_id", "analysis_type").agg(latest).select("photo_id", "analysis_type", "l.id", "l.started_at", "l.success")


def failed() -> Column:
    return F.col("success") == F.lit(False)


def incomplete() -> Column:
    return F.col("completed_at").isNull()


def duplicate_hashes(hashes: DataFrame, col: str = "file_hash") -> DataFrame:
    """Hashes that several photos share: count and smallest photo id."""
    rows = hashes.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("photos"), F.min("photo_id").alias("first_photo"))
    return rows.filter("photos > 1")
