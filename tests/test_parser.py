from datetime import UTC, date, datetime

import pytest

from prismalake.plans.query_parser import City, Country, Person, extract_persons, parse

TODAY = date(2026, 7, 6)
CITIES = [City("Paris", 48.85, 2.35), City("Nice", 43.7, 7.26), City("New York", 40.7, -74.0), City("York", 53.9, -1.1), City("Mumbai", 19.0, 72.8, ("Bombay",))]
PEOPLE = [Person(1, "Alice"), Person(2, "Bob Martin"), Person(3, "Marie"), Person(4, "Marie Curie")]
COUNTRIES = [Country("FR", ("France",)), Country("US", ("États-Unis", "United States"))]


def p(text):
    return parse(text, TODAY, CITIES, PEOPLE, COUNTRIES)


def days(d):
    to = lambda ms: datetime.fromtimestamp(ms / 1000, UTC).date().isoformat()
    return to(d.start_ms), to(d.end_ms)


@pytest.mark.parametrize(
    ("text", "first", "last", "rest"),
    [
        ("plage août 2023", "2023-08-01", "2023-08-31", "plage"),
        ("beach in february 2024", "2024-02-01", "2024-02-29", "beach"),
        ("05/2021", "2021-05-01", "2021-05-31", ""),
        ("2019 chat", "2019-01-01", "2019-12-31", "chat"),
        ("la semaine dernière", "2026-06-29", "2026-07-05", ""),
        ("last month", "2026-06-01", "2026-06-30", ""),
        ("l'été dernier", "2025-06-01", "2025-08-31", ""),
        ("last winter", "2025-12-01", "2026-02-28", ""),
        ("hier", "2026-07-05", "2026-07-05", ""),
        ("an dernier", "2025-01-01", "2025-12-31", ""),
        ("last spring", "2026-03-01", "2026-05-31", ""),
    ],
)
def test_dates(text, first, last, rest):
    got = p(text)
    assert days(got.dates) == (first, last)
    assert got.text == rest


@pytest.mark.parametrize("text", ["août", "13/2020", "1850", "month"])
def test_no_dates(text):
    assert p(text).dates is None


def test_last_millisecond():
    d = p("today").dates
    assert d.end_ms - d.start_ms == 86_400_000 - 1


def test_negation_takes_preposition_too():
    got = p("chien pas à Paris")
    assert got.place.negated and got.place.source == "pas à Paris" and got.text == "chien"


def test_longest_city_and_alias():
    assert p("new york").place.label == "New York"
    assert p("bombay").place.label == "Mumbai"


def test_types():
    assert p("captures d'écran").kind.media_type == 5
    got = p("no selfies")
    assert got.kind.media_type == 2 and got.kind.negated


def test_persons():
    got = p("Bob sans Alice")
    assert [(x.id, x.negated) for x in got.persons] == [(1, True), (2, False)] or [(x.id, x.negated) for x in got.persons] == [(2, False), (1, True)]
    assert p("marie curie").persons[0].id == 4
    assert [x.id for x in p("alice alice").persons] == [1]
    people, rest = extract_persons("photo with bob martin 2020", PEOPLE)
    assert [x.id for x in people] == [2] and rest == "photo 2020"


def test_countries():
    assert p("not in united states").country == type(p("france").country)("US", True, "not in united states")
    assert p("etats unis").country.code == "US"


def test_article_counts_as_preposition():
    assert p("a selfie").text == ""


def test_empty():
    assert p("  ").text == "" and not p("").filtered


def test_a_query_costs_its_own_words(monkeypatch):
    """Names are read once, not for every query."""
    from prismalake.plans import query_parser as qp

    calls = []
    monkeypatch.setattr(qp, "normalize_text", lambda t, f=qp.normalize_text: calls.append(t) or f(t))
    places = qp.city_phrases(City(f"Ville {k}", float(k), 0.0, (f"Old {k}",)) for k in range(1000))
    calls.clear()
    for k in range(20):
        got = parse(f"chat pas à ville {k} soir", TODAY, places)
        assert (got.place.label, got.place.negated, got.place.source, got.text) == (f"Ville {k}", True, f"pas à ville {k}", "chat soir")
    assert len(calls) == 20 * 6


def test_phrases_as_one_by_one():
    """Longest first, then as given, at the first place: the same as trying every phrase in turn."""
    import random

    from prismalake.plans.query_parser import Phrases, _longest_first, _Query

    rng = random.Random(5)
    for _ in range(500):
        given = [([rng.choice("uvwx") for _ in range(rng.randint(0, 3))], k) for k in range(rng.randint(0, 8))]
        text = " ".join(rng.choice(["u", "v", "w", "x", "not", "in"]) for _ in range(rng.randint(0, 7)))
        a, b, want = _Query(text), _Query(text), None
        for phrase, what in _longest_first(given):
            at = a.find(phrase)
            if at is not None:
                want = (what, *a.take(at, len(phrase)))
                break
        assert (Phrases(given).first(b), b.words) == (want, a.words)
