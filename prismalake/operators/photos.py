"""Photo queries: composable hard filters, projections, folders, counts, queues."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import in_box, in_country
from ..functions.text import contains_ascii_ci
from ..schemas import COMMITTED, SUMMARY

#: Ids up to which a list given by the caller is matched by a literal list.
LITERAL_IDS = 1000


def committed() -> Column:
    """A face that is assigned for good."""
    return F.col("assignment_type").isin(*COMMITTED)


def visible() -> Column:
    return ~F.col("is_hidden")


def newest_first() -> list[Column]:
    return [F.desc_nulls_last("date_taken"), F.asc("id")]


@dataclass(frozen=True)
class Criteria:
    """Optional filters, combined with AND."""

    text: str | None = None
    start_ms: int | None = None
    end_ms: int | None = None
    date_negated: bool = False
    media_type: int | None = None
    type_negated: bool = False
    box: tuple[float, float, float, float] | None = None
    geo_negated: bool = False
    country: str | None = None
    country_negated: bool = False
    persons: tuple[tuple[int, bool], ...] = field(default_factory=tuple)


def conditions(c: Criteria) -> list[Column]:
    """The criteria's row conditions; persons need joins and aren't among them.

    A negated date drops undated photos (three-valued logic), a negated place
    keeps photos without one.
    """
    out = [visible()]
    if c.start_ms is not None and c.end_ms is not None:
        inside = F.col("date_taken").between(c.start_ms, c.end_ms)
        out.append(~inside if c.date_negated else inside)
    if c.media_type is not None:
        same = F.col("media_type") == c.media_type
        out.append(~same if c.type_negated else same)
    if c.box is not None:
        inside = in_box(F.col("latitude"), F.col("longitude"), c.box)
        out.append(~inside if c.geo_negated else inside)
    if c.country is not None:
        inside = in_country(F.col("location_name"), c.country)
        out.append(~inside if c.country_negated else inside)
    if c.text:
        found = contains_ascii_ci(F.col("file_name"), c.text) | F.coalesce(contains_ascii_ci(F.col("relative_path"), c.text), F.lit(False))
        out.append(found)
    return out


def hard_filter(photos: DataFrame, faces: DataFrame, criteria: Criteria) -> DataFrame:
    """Visible photos that meet all criteria; each person is a semi- or anti-join over committed faces."""
    out = photos
    for cond in conditions(criteria):
        out = out.filter(cond)
    for person, negated in criteria.persons:
        of = faces.filter(committed() & (F.col("person_id") == person)).select(F.col("photo_id").alias("id"))
        out = out.join(of, "id", "left_anti" if negated else "left_semi")
    return out


def ordered(photos: DataFrame) -> DataFrame:
    return photos.orderBy(*newest_first())


def summaries(photos: DataFrame, only_visible: bool = True) -> DataFrame:
    return ordered((photos.filter(visible()) if only_visible else photos).select("*")).select(*SUMMARY)


def page(photos: DataFrame, number: int, size: int = 80, first: int = 120) -> DataFrame:
    """A page of the timeline; page 0 is longer."""
    skip, take = (0, first) if number == 0 else (first + (number - 1) * size, size)
    return ordered(photos.filter(visible())).offset(skip).limit(take).select(*SUMMARY)


def page_after(photos: DataFrame, date_taken: int | None, photo_id: int, size: int = 80) -> DataFrame:
    """The page behind a photo, by key: no rows are skipped over, so a late page costs what an early one does."""
    tie = F.col("date_taken").eqNullSafe(F.lit(date_taken).cast("long")) & (F.col("id") > photo_id)
    older = F.lit(False) if date_taken is None else (F.col("date_taken") < date_taken) | F.col("date_taken").isNull()
    return ordered(photos.filter(visible() & (older | tie))).limit(size).select(*SUMMARY)


def with_ids(df: DataFrame, ids: Iterable[int] | DataFrame, col: str = "id", negate: bool = False) -> DataFrame:
    """Rows whose ``col`` is, or isn't, among the ids: a literal list if it is short, else a semi- or anti-join."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col(ids.columns[0]).alias(col)), col, "left_anti" if negate else "left_semi")
    ids = list(ids)
    if len(ids) <= LITERAL_IDS:
        inside = F.col(col).isin(ids) if ids else F.lit(False)
        return df.filter(~inside if negate else inside)
    wanted = df.sparkSession.createDataFrame([(i,) for i in ids], f"{col} long")
    return df.join(wanted, col, "left_anti" if negate else "left_semi")


def reorder_by_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows in the order of a list (pos, id): missing ids drop out, repeated ids repeat their row."""
    return ids.select("pos", "id").join(df, "id").orderBy("pos")


def folder_albums(photos: DataFrame) -> DataFrame:
    """Visible photos by folder: count and the newest photo's path as cover, largest first.

    Undated photos are the last choice for a cover; of equals the smallest id.
    """
    newest = F.struct(F.coalesce(F.col("date_taken"), F.lit(-1)), -F.col("id"))
    rows = photos.filter(visible() & F.col("relative_path").isNotNull())
    out = rows.groupBy(F.col("relative_path").alias("folder_path")).agg(F.count("*").alias("photo_count"), F.max_by("file_path", newest).alias("cover_path"))
    return out.orderBy(F.desc("photo_count"), "folder_path")


def photo_counts(photos: DataFrame) -> DataFrame:
    """All and visible photos in one pass."""
    return photos.agg(F.count("*").alias("photo_count"), F.count_if(visible()).alias("visible_photo_count"))


def missing_analysis(photos: DataFrame, analyses: DataFrame, kind: str, model: str) -> DataFrame:
    """Visible photos without a row of the analysis; a row with a null embedding counts as done."""
    done = analyses.filter((F.col("analysis_type") == kind) & (F.col("model_name") == model)).select(F.col("photo_id").alias("id"))
    return photos.filter(visible()).join(done, "id", "left_anti")


def embeddings_of(analyses: DataFrame, kind: str, model: str) -> DataFrame:
    right = (F.col("analysis_type") == kind) & (F.col("model_name") == model) & F.col("embedding").isNotNull()
    return analyses.filter(right).select("photo_id", "embedding", "embedding_dim")


def embeddings_chunk(analyses: DataFrame, kind: str, model: str, after: int = 0, size: int = 2000) -> DataFrame:
    """The next rows by photo id (ids of 0 and less are never reached from the start)."""
    return embeddings_of(analyses, kind, model).filter(F.col("photo_id") > after).orderBy("photo_id").limit(size)


def photos_by_person(photos: DataFrame, faces: DataFrame, person: int) -> DataFrame:
    return ordered(hard_filter(photos, faces, Criteria(persons=((person, False),)))).select(*SUMMARY)


def known_cities(photos: DataFrame, cities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Cities named by visible photos' labels, each with its aliases; of namesakes the largest, then the smallest id."""
    from ..functions.geo import split_location

    name, code = split_location(F.col("location_name"))
    labels = photos.filter(visible() & F.col("location_name").isNotNull()).select("location_name").distinct().select(name.alias("n"), code.alias("c")).filter("n <> '' and c <> ''")
    best = F.min(F.struct((-F.coalesce(F.col("population"), F.lit(-1))).alias("p"), "id", "latitude", "longitude")).alias("b")
    found = cities.join(labels, (F.col("name") == F.col("n")) & (F.col("country_code") == F.col("c")), "left_semi").groupBy("name", "country_code").agg(best)
    found = found.select(F.col("b.id").alias("id"), "name", "b.latitude", "b.longitude")
    also = aliases.groupBy(F.col("city_id").alias("id")).agg(F.array_sort(F.collect_list("alias")).alias("aliases"))
    return found.join(also, "id", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
