"""Mutations as functions from the table before to the table after.

Plain Parquet has no UPDATE: each function returns the whole new state, and
``swap`` writes it beside the old one before the new one takes its name.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .photos import committed


def one_of_each(rows: DataFrame, keys: Sequence[str], order: Sequence[str] = (), last: bool = True) -> DataFrame:
    """One row a key: the last (or first) in ``order``, ties and no order by all columns; rows with a null key never conflict and stay.

    A pre-aggregated maximum, so a key with very many rows doesn't meet in one task.
    """
    known = reduce(and_, (F.col(k).isNotNull() for k in keys))
    plain = [c for c, kind in rows.dtypes if not kind.startswith("map")]
    place = F.struct(*order, *(c for c in plain if c not in order))
    pick = F.max_by if last else F.min_by
    best = rows.filter(known).groupBy(*keys).agg(pick(F.struct(*rows.columns), place).alias("__row"))
    return best.select("__row.*").unionByName(rows.filter(~known))


def upsert(target: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Rows replace those with their key in place, the last of several with one key (by ``order``); child rows aren't touched."""
    rows = one_of_each(rows.select(*dict.fromkeys([*target.columns, *order])), keys, order).select(*target.columns)
    return target.join(rows.select(*keys), list(keys), "left_anti").select(*target.columns).unionByName(rows)


#: A conflict deletes the old row and inserts the new one: the same state as an upsert of whole rows.
insert_replace = upsert


def insert_ignore(target: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Rows whose key is new, the first of several with one key (by ``order``); null keys never conflict."""
    rows = one_of_each(rows.select(*dict.fromkeys([*target.columns, *order])), keys, order, last=False)
    return target.unionByName(rows.join(target.select(*keys), list(keys), "left_anti").select(*target.columns))


def insert_abort(target: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows, or an error in the running query if one has the key of another."""
    both = target.unionByName(rows.select(*target.columns))
    twice = both.groupBy(*keys).agg(F.count("*").alias("__n"))
    checked = twice.select(*keys, F.when(F.col("__n") > 1, F.raise_error(F.lit("key exists")).cast("long")).otherwise(F.col("__n")).alias("__n"))
    return both.join(checked, list(keys)).filter(F.col("__n") == 1).select(*target.columns)


def delete_where(target: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition isn't true."""
    return target.filter(~F.coalesce(condition, F.lit(False)))


def delete_keys(target: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return target.join(gone.select(*keys), list(keys), "left_anti").select(*target.columns)


def update_where(target: DataFrame, condition: Column, values: Mapping[str, Column]) -> DataFrame:
    """New values where the condition is true; all are computed from the old row."""
    hit = F.coalesce(condition, F.lit(False))
    kinds = dict(target.dtypes)
    return target.select(*(F.when(hit, values[c].cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in target.columns))


#: Children of a photo by their column, and columns that lose their photo instead.
CASCADES = {"photo_analyses": "photo_id", "faces": "photo_id", "album_photos": "photo_id", "photo_hashes": "photo_id", "analysis_log": "photo_id"}
NULLED = {"albums": "cover_photo_id"}


def delete_photos(tables: Mapping[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All tables after photos (column ``id``) are deleted, with cascades and lost covers."""
    out = dict(tables)
    out["photos"] = delete_keys(tables["photos"], gone, ["id"])
    for name, col in CASCADES.items():
        if name in tables:
            out[name] = delete_keys(tables[name], gone.select(F.col("id").alias(col)), [col])
    for name, col in NULLED.items():
        if name in tables:
            t, lost = tables[name], gone.select(F.col("id").alias("__gone")).distinct()
            out[name] = t.join(lost, t[col] == lost["__gone"], "left").withColumn(col, F.when(F.col("__gone").isNull(), F.col(col))).select(*t.columns)
    return out


def delete_person(persons: DataFrame, faces: DataFrame, person: int) -> tuple[DataFrame, DataFrame]:
    """Persons and faces after a person goes; its faces keep everything but the person."""
    return delete_where(persons, F.col("id") == person), update_where(faces, F.col("person_id") == person, {"person_id": F.lit(None)})


def recalc_person_counts(persons: DataFrame, faces: DataFrame, only: int | None = None) -> DataFrame:
    """photo_count: different photos with a committed face of the person."""
    n = faces.filter(committed()).groupBy(F.col("person_id").alias("id")).agg(F.countDistinct("photo_id").alias("__n"))
    new = F.coalesce("__n", F.lit(0)).cast("int")
    return persons.join(n, "id", "left").withColumn("photo_count", new if only is None else F.when(F.col("id") == only, new).otherwise(F.col("photo_count"))).select(*persons.columns)


def recalc_album_counts(albums: DataFrame, album_photos: DataFrame, only: int | None = None) -> DataFrame:
    n = album_photos.groupBy(F.col("album_id").alias("id")).agg(F.count("*").alias("__n"))
    new = F.coalesce("__n", F.lit(0)).cast("int")
    return albums.join(n, "id", "left").withColumn("photo_count", new if only is None else F.when(F.col("id") == only, new).otherwise(F.col("photo_count"))).select(*albums.columns)


def delete_empty_unnamed(persons: DataFrame) -> DataFrame:
    return delete_where(persons, (F.col("photo_count") == 0) & F.col("name").isNull())


def cleanup(persons: DataFrame, faces: DataFrame) -> DataFrame:
    """Recount, then drop empty unnamed persons; doing it again changes nothing."""
    return delete_empty_unnamed(recalc_person_counts(persons, faces))


def activate_model(models: DataFrame, model_id: int) -> DataFrame:
    """The model becomes the only active one of its type."""
    kind = F.broadcast(models.filter(F.col("id") == model_id).select(F.col("model_type").alias("__t")))
    joined = models.join(kind, models["model_type"] == kind["__t"], "left")
    return joined.withColumn("is_active", F.when(F.col("__t").isNotNull(), F.col("id") == model_id).otherwise(F.col("is_active"))).select(*models.columns)


def places(spark: SparkSession, path: str) -> tuple:
    """The file system of a table, where its next and its last state lie while they are swapped (names that readers skip), and the table."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    now = jpath(path)
    beside = lambda what: jpath(now.getParent(), f"_{now.getName().replace('=', '-')}.{what}")
    return now.getFileSystem(spark._jsc.hadoopConfiguration()), beside("new"), beside("old"), now


def recover(spark: SparkSession, path: str) -> None:
    """Finish a ``swap`` that was stopped between its renames: the new table if it was whole, else the old one."""
    fs, new, old, now = places(spark, path)
    if not fs.exists(now):
        whole = fs.exists(spark._jvm.org.apache.hadoop.fs.Path(new, "_SUCCESS"))
        if whole or fs.exists(old):
            fs.rename(new if whole else old, now)


def swap(df: DataFrame, path: str) -> None:
    """Write ``df`` in place of the table at ``path``: beside it first, then by two renames of the file system.

    Stopped between them, the table is missing until ``recover`` puts it back;
    what reads the tables of a sync calls that first.
    """
    fs, new, old, now = places(df.sparkSession, path)
    df.write.mode("overwrite").parquet(new.toString())
    fs.delete(old, True)
    if fs.exists(now) and not fs.rename(now, old):
        raise OSError(f"{path} can't be moved")
    if not fs.rename(new, now):
        raise OSError(f"{new.toString()} can't be moved")
    fs.delete(old, True)
