"""Free-text search: parsed filters and exact similarity in one plan, with its fallbacks."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field, replace
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import box_of_radius, country_suffix
from ..functions.vectors import scored, top_k
from ..operators import photos as ph
from ..operators.photos import Criteria
from .query_parser import City, Country, Parsed, Person, extract_persons, parse

FLOOR = 0.2
MOST = 200
#: Filters that can be taken off a search one by one.
FILTERS = frozenset(("dates", "place", "kind", "country"))

#: Fixed names of some countries in French and English.
COUNTRY_NAMES = {
    "AT": ("Autriche", "Austria"), "BE": ("Belgique", "Belgium"), "BR": ("Brésil", "Brazil"), "CA": ("Canada",), "CH": ("Suisse", "Switzerland"),
    "CN": ("Chine", "China"), "DE": ("Allemagne", "Germany"), "ES": ("Espagne", "Spain"), "FR": ("France",), "GB": ("Royaume-Uni", "United Kingdom"),
    "GR": ("Grèce", "Greece"), "IE": ("Irlande", "Ireland"), "IN": ("Inde", "India"), "IT": ("Italie", "Italy"), "JP": ("Japon", "Japan"),
    "MA": ("Maroc", "Morocco"), "NL": ("Pays-Bas", "Netherlands"), "PT": ("Portugal",), "SE": ("Suède", "Sweden"), "US": ("États-Unis", "United States"),
}


@dataclass(frozen=True)
class Library:
    """The tables a search reads. Names of persons, cities and countries that the parser needs are looked up once a library."""

    photos: DataFrame
    faces: DataFrame
    analyses: DataFrame
    persons: DataFrame
    cities: DataFrame
    aliases: DataFrame
    known: dict = field(default_factory=dict, compare=False, repr=False)

    def once(self, name: str, look_up: Callable[[], object]) -> object:
        if name not in self.known:
            self.known[name] = look_up()
        return self.known[name]


@dataclass(frozen=True)
class Result:
    parsed: Parsed
    photos: DataFrame
    scores: bool = False
    translated: str | None = None
    translation_missing: bool = False


def criteria(p: Parsed) -> Criteria:
    return Criteria(
        text=p.text.strip() or None,
        start_ms=p.dates and p.dates.start_ms,
        end_ms=p.dates and p.dates.end_ms,
        date_negated=bool(p.dates and p.dates.negated),
        media_type=p.kind.media_type if p.kind else None,
        type_negated=bool(p.kind and p.kind.negated),
        box=box_of_radius(p.place.latitude, p.place.longitude, p.place.radius_km) if p.place else None,
        geo_negated=bool(p.place and p.place.negated),
        country=p.country and p.country.code,
        country_negated=bool(p.country and p.country.negated),
        persons=tuple((x.id, x.negated) for x in p.persons),
    )


def run_filters(lib: Library, p: Parsed) -> DataFrame:
    return ph.ordered(ph.hard_filter(lib.photos, lib.faces, criteria(p))).select(*ph.SUMMARY)


def similarity_floor(debug: bool = False, override: float | None = None, of_model: float | None = None) -> float:
    if debug:
        return float("-inf")
    return next((x for x in (override, of_model) if x is not None), FLOOR)


def semantic(lib: Library, p: Parsed, vector: Sequence[float], model: str, floor: float = FLOOR, most: int = MOST) -> DataFrame:
    """The best visible photos that meet the filters, by similarity: summary columns and score."""
    shown = ph.hard_filter(lib.photos, lib.faces, criteria(replace(p, text=""))).select(*ph.SUMMARY)
    rows = scored(ph.embeddings_of(lib.analyses, "clip_embedding", model), vector).filter(F.col("score") >= floor)
    return top_k(rows.join(shown, "id"), most).select(*ph.SUMMARY, "score")


def returned(p: Parsed, which: str) -> Parsed | None:
    """The query with the words of its place or country given back to the text; None if there are none to give."""
    was = getattr(p, which)
    if was is None or was.negated:
        return None
    return replace(p, text=f"{p.text} {was.source}".strip(), **{which: None})


def _some(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


def search_parsed(lib: Library, p: Parsed, encode: Callable[[str], Sequence[float]] | None = None, model: str = "m1", floor: float = FLOOR) -> Result:
    """With an encoder, similarity inside the filters, else a text match; each falls back in its own order."""
    if not p.filtered and len(p.text.strip()) < 2:
        return Result(p, lib.photos.select(*ph.SUMMARY).limit(0))
    if p.text.strip() and encode is not None:
        found = Result(p, semantic(lib, p, encode(p.text), model, floor), True)
        if _some(found.photos):
            return found
        for q in filter(None, (returned(p, "place"), returned(p, "country"))):
            again = semantic(lib, q, encode(q.text), model, floor)
            if _some(again):
                return Result(q, again, True)
        return found
    found = run_filters(lib, p)
    if _some(found):
        return Result(p, found)
    without_text = replace(p, text="") if p.text.strip() and p.filtered else None
    for q in filter(None, (returned(p, "place"), returned(p, "country"), without_text)):
        again = run_filters(lib, q)
        if _some(again):
            return Result(q, again)
    return Result(p, found)


def known_places(lib: Library) -> tuple[list[City], list[Country]]:
    """Cities and countries that the library's own labels name (one row a distinct label comes to the driver)."""
    cities = [City(r.name, r.latitude, r.longitude, tuple(r.aliases)) for r in ph.known_cities(lib.photos, lib.cities, lib.aliases).orderBy("id").collect()]
    codes = lib.photos.filter(ph.visible()).select(country_suffix(F.col("location_name")).alias("c")).filter("c is not null").distinct().orderBy("c").collect()
    return cities, [Country(r.c.upper(), COUNTRY_NAMES[r.c.upper()]) for r in codes if r.c.upper() in COUNTRY_NAMES]


def search(
    lib: Library,
    query: str,
    today: date,
    encode: Callable[[str], Sequence[float]] | None = None,
    translate: Callable[[str], str | None] | None = None,
    encoder_knows_language: bool = True,
    use: frozenset[str] = FILTERS,
    removed_persons: Iterable[int] = (),
    model: str = "m1",
    floor: float = FLOOR,
    zone: str = "UTC",
) -> Result:
    """A whole search: persons from the raw text, then translation, the other filters, and the cascade.

    A filter that isn't in ``use``, or a removed person, constrains nothing, and
    its words don't return to the text.
    """
    persons = lib.once("persons", lambda: [Person(r.id, r.name) for r in lib.persons.filter("name is not null").select("id", "name").orderBy("id").collect()])
    people, rest = extract_persons(query, persons)
    translated = translate(rest) if translate and rest.strip() else None
    cities, countries = lib.once("places", lambda: known_places(lib))
    p = parse(translated if translated is not None else rest, today, cities, (), countries, zone)
    gone = set(removed_persons)
    p = replace(p, persons=tuple(x for x in people if x.id not in gone), **{f: None for f in ("dates", "place", "kind", "country") if f not in use})
    out = search_parsed(lib, p, encode, model, floor)
    return replace(out, translated=translated, translation_missing=translated is None and not encoder_knows_language)


@dataclass
class Sitting:
    """State of one search box: its query, the filters taken off, and a generation that tells a late result from the current one."""

    query: str = ""
    use: frozenset[str] = FILTERS
    removed_persons: frozenset[int] = frozenset()
    generation: int = 0
    result: object = None

    def submit(self, query: str) -> int:
        """A new query: every filter counts again."""
        self.query, self.use, self.removed_persons = query, FILTERS, frozenset()
        return self._next()

    def remove_filter(self, name: str) -> int:
        self.use = self.use - {name}
        return self._next()

    def remove_person(self, person: int) -> int:
        self.removed_persons = self.removed_persons | {person}
        return self._next()

    def _next(self) -> int:
        self.generation += 1
        if not self.query.strip():
            self.result = None
        return self.generation

    def arrived(self, generation: int, result: object) -> bool:
        """Whether a result is the current one's; a late one is dropped."""
        if generation != self.generation:
            return False
        self.result = result
        return True

    def run(self, lib: Library, today: date, **options) -> Result | None:
        """The current search; None for a blank query."""
        if not self.query.strip():
            return None
        return search(lib, self.query, today, use=self.use, removed_persons=self.removed_persons, **options)


class Recent(OrderedDict):
    """The last ``size`` entries by use: result lists of open searches, translations."""

    def __init__(self, size: int) -> None:
        super().__init__()
        self.size = size

    def __getitem__(self, key):
        self.move_to_end(key)
        return super().__getitem__(key)

    def __setitem__(self, key, value) -> None:
        super().__setitem__(key, value)
        self.move_to_end(key)
        while len(self) > self.size:
            self.popitem(last=False)
