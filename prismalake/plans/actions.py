"""Actions that combine table changes: naming, hiding, merging, resets, settings."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import mutate, people
from ..operators.people import Merge
from .search import FLOOR


@dataclass(frozen=True)
class Settings:
    """Preferences with their defaults."""

    included_folders: frozenset[str] = frozenset()
    cursors: Mapping[str, int] = field(default_factory=dict)
    auto_clustering: bool = True
    show_hidden_people: bool = False
    show_scores: bool = False
    quality_floor: float = people.QUALITY
    threshold_high: float = people.AUTO
    threshold_medium: float = people.PENDING
    threshold_merge: float = people.MERGE
    search_floor: float | None = None
    query_language: str = "system"
    app_language: str = "en"

    def language(self) -> str:
        return self.app_language if self.query_language == "system" else self.query_language

    def floor(self, of_model: float | None = None) -> float:
        if self.show_scores:
            return float("-inf")
        return self.search_floor if self.search_floor is not None else of_model if of_model is not None else FLOOR


def reset_settings(s: Settings) -> Settings:
    """Defaults; where the library stands stays."""
    return Settings(included_folders=s.included_folders, cursors=s.cursors, app_language=s.app_language)


def apply_included_folders(s: Settings, folders: frozenset[str]) -> Settings:
    """A new choice of folders; a folder that is new to it starts at cursor 0, so its older photos are found."""
    return replace(s, included_folders=folders, cursors={f: s.cursors.get(f, 0) for f in folders})


def reset_database(tables: Mapping[str, DataFrame], s: Settings) -> tuple[dict[str, DataFrame], Settings]:
    """Photos, persons, faces, albums and what hangs on them emptied, cursors at 0; cities and models stay."""
    kept = {"cities", "city_aliases", "ai_models"}
    return {k: v if k in kept else v.limit(0) for k, v in tables.items()}, replace(s, cursors={f: 0 for f in s.cursors})


def name_group(persons: DataFrame, faces: DataFrame, person: int, name: str, now: int) -> tuple[DataFrame, DataFrame]:
    """A name that another person has merges the two, else the group gets it."""
    return people.rename_or_merge(persons, faces, person, name, now)


def name_face(persons: DataFrame, faces: DataFrame, face: int, name: str, new_id: int, now: int) -> tuple[DataFrame, DataFrame]:
    """One face to the person of a name, made if there is none: by hand, confidence 1, its stored weight, new centroid."""
    made = people.create_person(persons, new_id, name, now)
    formatted = made.sparkSession.range(1).select(people.format_person_name(F.lit(name)).alias("n")).first().n
    person = people.person_by_name(made, formatted).select("id").first().id
    row = faces.filter(F.col("id") == face).select("weight").first()
    made, after = people.assign_face(made, faces, face, person, "manual", 1.0, float(row.weight) if row else 1.0, now)
    return people.recompute_centroids(made, after, now, person), after


def rename_person(persons: DataFrame, person: int, name: str) -> DataFrame:
    """A plain update; a name that another person has raises."""
    new = mutate.update_where(persons, F.col("id") == person, {"name": people.format_person_name(F.lit(name))})
    twice = new.filter("name is not null").groupBy(people.ascii_lower(F.col("name"))).count().filter("count > 1")
    if twice.limit(1).count():
        raise ValueError(f"the name {name!r} is taken")
    return new


def exclude_or_hide(persons: DataFrame, faces: DataFrame, target: tuple[str, int], exclude: bool, reason: str, new_id: int, now: int) -> tuple[DataFrame, DataFrame]:
    """A group is excluded or hidden; a face is ignored or becomes a hidden stranger."""
    kind, i = target
    if kind == "group":
        return people.exclude_person(persons, faces, i, reason, now) if exclude else (people.hide_person(persons, i), faces)
    return people.mark_ignored(persons, faces, i, reason, now) if exclude else people.hide_as_stranger(persons, faces, i, new_id, now)


@dataclass
class Session:
    """What a sitting remembers: skipped questions and dismissed merges."""

    skipped: set[tuple[str, int]] = field(default_factory=set)
    dismissed: set[frozenset[int]] = field(default_factory=set)

    def dismiss(self, m: Merge) -> None:
        self.dismissed.add(frozenset((m.keep, m.merge)))

    def remaining(self, open_questions: int) -> int:
        return max(0, open_questions - len(self.skipped))


class Scans:
    """One scan at a time: a gallery scan is dropped while another runs, a full one takes its place; resets wait for none to run."""

    def __init__(self) -> None:
        self.running: str | None = None
        self.cancelled = False

    def start(self, kind: str) -> bool:
        if self.running and kind == "gallery":
            return False
        self.running, self.cancelled = kind, False
        return True

    def cancel(self) -> None:
        self.cancelled, self.running = self.running is not None, None

    def exclusively(self, action: Callable[[], None]) -> None:
        self.cancel()
        action()
