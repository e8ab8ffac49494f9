"""Natural-language queries in French and English to filters.

A query is a list of tokens. Extractors run in a fixed order (date, media type,
persons, city, country); each takes the phrase it recognises out of the list,
with a preposition and then a negation directly before it, and what nobody
takes is free text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from datetime import date, timedelta

import regex

from ..functions.geo import RADIUS_KM
from ..functions.text import normalize_text
from ..functions.timeline import date_range_ms
from ..schemas import SCREENSHOT, SELFIE

WORD = regex.compile(r"[\p{L}\p{Nd}]+(?:/\p{Nd}+)?")
YEAR = re.compile(r"(?:19|20)\d\d", re.A)
MONTH_YEAR = re.compile(r"(0?[1-9]|1[0-2])/((?:19|20)\d\d)", re.A)

#: Fixed word lists, normalised.
PREPOSITIONS = {"a", "au", "aux", "en", "de", "du", "des", "pendant", "vers", "avec", "in", "on", "at", "during", "around", "near", "with"}
NEGATIONS = {"pas", "sans", "non", "hors", "sauf", "not", "without", "no", "except", "excluding"}
MONTHS = (
    ("janvier", "january"), ("fevrier", "february"), ("mars", "march"), ("avril", "april"), ("mai", "may"), ("juin", "june"),
    ("juillet", "july"), ("aout", "august"), ("septembre", "september"), ("octobre", "october"), ("novembre", "november"), ("decembre", "december"),
)
TYPE_PHRASES = {
    SCREENSHOT: ("capture d ecran", "captures d ecran", "capture ecran", "captures ecran", "screenshot", "screenshots", "screen shot", "screen shots"),
    SELFIE: ("selfie", "selfies", "autoportrait", "autoportraits"),
}
#: Fixed relative dates: what each phrase means is in ``RELATIVE``.
DATE_PHRASES = {
    "today": ("aujourd hui", "today"),
    "yesterday": ("hier", "yesterday"),
    "week": ("la semaine derniere", "semaine derniere", "last week"),
    "month": ("le mois dernier", "mois dernier", "last month"),
    "year": ("l annee derniere", "annee derniere", "l an dernier", "an dernier", "last year"),
    "spring": ("le printemps dernier", "printemps dernier", "last spring"),
    "summer": ("l ete dernier", "ete dernier", "last summer"),
    "autumn": ("l automne dernier", "automne dernier", "last autumn", "last fall"),
    "winter": ("l hiver dernier", "hiver dernier", "last winter"),
}


def month_end(year: int, month: int) -> date:
    return date(year + month // 12, month % 12 + 1, 1) - timedelta(days=1)


def last_season(today: date, first: int, last: int) -> tuple[date, date]:
    """The latest season that is wholly over; one that begins in a later month than it ends began the year before."""
    year = today.year if month_end(today.year, last) < today else today.year - 1
    return date(year - (first > last), first, 1), month_end(year, last)


def last_month(today: date) -> tuple[date, date]:
    end = today.replace(day=1) - timedelta(days=1)
    return end.replace(day=1), end


def last_week(today: date) -> tuple[date, date]:
    monday = today - timedelta(days=today.weekday() + 7)
    return monday, monday + timedelta(days=6)


RELATIVE: dict[str, Callable[[date], tuple[date, date]]] = {
    "today": lambda d: (d, d),
    "yesterday": lambda d: (d - timedelta(days=1),) * 2,
    "week": last_week,
    "month": last_month,
    "year": lambda d: (date(d.year - 1, 1, 1), date(d.year - 1, 12, 31)),
    "spring": lambda d: last_season(d, 3, 5),
    "summer": lambda d: last_season(d, 6, 8),
    "autumn": lambda d: last_season(d, 9, 11),
    "winter": lambda d: last_season(d, 12, 2),
}


@dataclass(frozen=True)
class City:
    name: str
    latitude: float
    longitude: float
    aliases: tuple[str, ...] = ()


@dataclass(frozen=True)
class Country:
    code: str
    names: tuple[str, ...]


@dataclass(frozen=True)
class Person:
    id: int
    name: str


@dataclass(frozen=True)
class Dates:
    start_ms: int
    end_ms: int
    negated: bool
    source: str


@dataclass(frozen=True)
class Kind:
    media_type: int
    negated: bool
    source: str


@dataclass(frozen=True)
class Place:
    latitude: float
    longitude: float
    radius_km: float
    label: str
    negated: bool
    source: str


@dataclass(frozen=True)
class InCountry:
    code: str
    negated: bool
    source: str


@dataclass(frozen=True)
class WithPerson:
    id: int
    name: str
    negated: bool
    source: str


@dataclass(frozen=True)
class Parsed:
    text: str = ""
    dates: Dates | None = None
    place: Place | None = None
    kind: Kind | None = None
    persons: tuple[WithPerson, ...] = field(default_factory=tuple)
    country: InCountry | None = None

    @property
    def filtered(self) -> bool:
        return bool(self.dates or self.place or self.kind or self.persons or self.country)


class _Query:
    """The tokens that are left of a query."""

    def __init__(self, text: str) -> None:
        self.words = WORD.findall(text)
        self.keys = [normalize_text(w) for w in self.words]

    @property
    def rest(self) -> str:
        return " ".join(self.words)

    def find(self, phrase: Sequence[str]) -> int | None:
        n = len(phrase)
        return next((i for i in range(len(self.keys) - n + 1) if self.keys[i : i + n] == list(phrase)), None) if n else None

    def take(self, start: int, count: int) -> tuple[bool, str]:
        """Remove a phrase with what qualifies it; whether it was negated and what was removed."""
        first, negated = start, False
        if first and self.keys[first - 1] in PREPOSITIONS:
            first -= 1
        if first and self.keys[first - 1] in NEGATIONS:
            first, negated = first - 1, True
        gone = slice(first, start + count)
        source = " ".join(self.words[gone])
        del self.words[gone], self.keys[gone]
        return negated, source


def find_phrase(text: str, phrase: str) -> int | None:
    """Place of the first word of a phrase among the words of a text, both normalised; None if it doesn't occur."""
    return _Query(text).find(_Query(phrase).keys)


def _keys(text: str) -> list[str]:
    return _Query(text).keys


def _longest_first(phrases: Iterable[tuple[list[str], object]]) -> list[tuple[list[str], object]]:
    return sorted(((p, what) for p, what in phrases if p), key=lambda x: -len(x[0]))


class Phrases:
    """Phrases looked up by their words: a query costs its own words, whatever the number of phrases."""

    def __init__(self, phrases: Iterable[tuple[list[str], object]]) -> None:
        self.of: dict[tuple[str, ...], tuple[int, object]] = {}
        for k, (phrase, what) in enumerate(phrases):
            if phrase:
                self.of.setdefault(tuple(phrase), (k, what))
        self.sizes = sorted({len(p) for p in self.of}, reverse=True)

    def first(self, q: _Query) -> tuple[object, bool, str] | None:
        """The longest phrase that occurs (the first given of equal lengths), taken out where it first does."""
        for n in self.sizes:
            hits = ((*self.of[p], i) for i in range(len(q.keys) - n + 1) if (p := tuple(q.keys[i : i + n])) in self.of)
            best = min(hits, key=lambda h: h[0], default=None)
            if best is not None:
                return best[1], *q.take(best[2], n)
        return None


def city_phrases(cities: Iterable[City]) -> Phrases:
    """Names and aliases, to be made once for many queries."""
    return Phrases((_keys(n), c) for c in cities for n in (c.name, *c.aliases))


def country_phrases(countries: Iterable[Country]) -> Phrases:
    return Phrases((_keys(n), c.code) for c in countries for n in c.names)


_DATES = Phrases((p.split(), name) for name, phrases in DATE_PHRASES.items() for p in phrases)
_TYPES = Phrases((p.split(), kind) for kind, phrases in TYPE_PHRASES.items() for p in phrases)
_MONTH_OF = {name: k for k, names in enumerate(MONTHS, 1) for name in names}


def _dates(q: _Query, today: date, zone: str) -> Dates | None:
    hit = _DATES.first(q)
    if hit:
        return Dates(*date_range_ms(*RELATIVE[hit[0]](today), zone), hit[1], hit[2])
    for i, key in enumerate(q.keys):
        after = q.keys[i + 1] if i + 1 < len(q.keys) else ""
        if key in _MONTH_OF and after.isdecimal() and 1900 <= int(after) <= 2099:
            first, last, n = date(int(after), _MONTH_OF[key], 1), month_end(int(after), _MONTH_OF[key]), 2
        elif m := MONTH_YEAR.fullmatch(key):
            first, last, n = date(int(m[2]), int(m[1]), 1), month_end(int(m[2]), int(m[1])), 1
        elif YEAR.fullmatch(key):
            first, last, n = date(int(key), 1, 1), date(int(key), 12, 31), 1
        else:
            continue
        return Dates(*date_range_ms(first, last, zone), *q.take(i, n))
    return None


def _persons(q: _Query, persons: Iterable[Person]) -> tuple[WithPerson, ...]:
    """Full names, longest first; where none is left, first names that one person only has; each person once."""
    named = _longest_first((_keys(p.name), p) for p in persons)
    firsts = Counter(keys[0] for keys, _ in named)
    alone = {keys[0]: p for keys, p in named if firsts[keys[0]] == 1}
    found: dict[int, WithPerson] = {}

    def once() -> bool:
        for keys, p in named:
            at = q.find(keys)
            if p.id not in found and at is not None:
                found[p.id] = WithPerson(p.id, p.name, *q.take(at, len(keys)))
                return True
        for i, key in enumerate(q.keys):
            p = alone.get(key)
            if p is not None and p.id not in found:
                found[p.id] = WithPerson(p.id, p.name, *q.take(i, 1))
                return True
        return False

    while once():
        pass
    return tuple(found.values())


def extract_persons(text: str, persons: Iterable[Person]) -> tuple[tuple[WithPerson, ...], str]:
    """Persons of a raw query, before any translation, and the text that is left."""
    q = _Query(text)
    return _persons(q, persons), q.rest


def parse(text: str, today: date, cities: Iterable[City] | Phrases = (), persons: Iterable[Person] = (), countries: Iterable[Country] | Phrases = (), zone: str = "UTC") -> Parsed:
    """Filters and free text of a query."""
    q = _Query(text)
    dates = _dates(q, today, zone)
    kind = _TYPES.first(q)
    people = _persons(q, persons)
    city = (cities if isinstance(cities, Phrases) else city_phrases(cities)).first(q)
    country = (countries if isinstance(countries, Phrases) else country_phrases(countries)).first(q)
    return Parsed(
        q.rest,
        dates,
        city and Place(city[0].latitude, city[0].longitude, RADIUS_KM, city[0].name, city[1], city[2]),
        kind and Kind(*kind),
        people,
        country and InCountry(*country),
    )
