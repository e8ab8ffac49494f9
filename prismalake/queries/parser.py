"""The query parser over whole columns of queries, against SQL that works out what each must mean."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rowwise import map_rows
from ..functions.text import normalize_text
from ..plans import query_parser as qp
from . import register

TODAY = date(2026, 7, 6)
EPOCH = date(1970, 1, 1).toordinal()


def over(view: str, columns: str, one: Callable[..., tuple], schema: str) -> Callable:
    """A query that applies ``one`` to the columns of each row of a view; rows are dealt out, as a file may be one task."""
    return lambda g: map_rows(g.view(view).select(*columns.split()).repartition(*columns.split()), lambda: one, schema)


def documents(g) -> DataFrame:
    return g.spark.read.parquet(f"{g.dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


# ---- words
WORDS = r"[\p{L}\p{Nd}]+(?:/\p{Nd}+)?"
NORMAL = "replace(replace(strip_accents(lower(coalesce(text, ''))), 'œ', 'oe'), 'æ', 'ae')"
register(
    "tokenize",
    lambda g: map_rows(documents(g), lambda: lambda i, t: (i, len(qp.WORD.findall(t)), "|".join(qp.WORD.findall(t))), "id long, n long, tokens string"),
    f"SELECT doc_id AS id, len(regexp_extract_all(text, '{WORDS}')) AS n, array_to_string(regexp_extract_all(text, '{WORDS}'), '|') AS tokens FROM documents",
)
register(
    "lexicons",
    lambda g: map_rows(documents(g), lambda: lambda i, t: (i, *(sum(normalize_text(w) in words for w in qp.WORD.findall(t)) for words in (qp.PREPOSITIONS, qp.NEGATIONS))), "id long, prepositions long, negations long"),
    f"""WITH w AS (SELECT doc_id AS id, regexp_extract_all({NORMAL}, '{WORDS}') AS w FROM documents)
        SELECT id, len(list_filter(w, lambda x: x IN ('a', 'au', 'aux', 'en', 'de', 'du', 'des', 'pendant', 'vers', 'avec', 'in', 'on', 'at', 'during', 'around', 'near', 'with'))) AS prepositions,
               len(list_filter(w, lambda x: x IN ('pas', 'sans', 'non', 'hors', 'sauf', 'not', 'without', 'no', 'except', 'excluding'))) AS negations FROM w""",
)
register(
    "index_of_phrase",
    lambda g: map_rows(documents(g), lambda: lambda i, t: (i, qp.find_phrase(t, "of the")), "id long, pos long"),
    f"""WITH w AS (SELECT doc_id AS id, regexp_extract_all({NORMAL}, '{WORDS}') AS w FROM documents)
        SELECT id, CAST(list_filter(range(0, len(w) - 1), lambda i: w[i + 1] = 'of' AND w[i + 2] = 'the')[1] AS BIGINT) AS pos FROM w""",
)

# ---- dates
dated = lambda p: (p.text, p.dates and p.dates.start_ms, p.dates and p.dates.end_ms, p.dates and p.dates.negated)
register(
    "extract_date",
    over("asked_dates", "id q", lambda i, q: (i, *dated(qp.parse(q, TODAY))), "id long, rest string, a long, b long, negated boolean"),
    """SELECT id, CASE k WHEN 0 THEN 'plage' WHEN 1 THEN 'beach sun' WHEN 2 THEN '' ELSE 'x 13/2020' END AS rest,
       epoch_ms(make_timestamp(y, CASE WHEN k = 3 THEN 1 ELSE m END, 1, 0, 0, 0)) AS a,
       epoch_ms(CASE WHEN k = 3 OR m = 12 THEN make_timestamp(y + 1, 1, 1, 0, 0, 0) ELSE make_timestamp(y, m + 1, 1, 0, 0, 0) END) - 1 AS b, k = 1 AS negated FROM asked_dates""",
    "asked_dates",
)
register(
    "relative_ranges",
    over("asked_relative", "id q day", lambda i, q, day: (i, *dated(qp.parse(q, date.fromordinal(day + EPOCH)))[:3]), "id long, rest string, a long, b long"),
    """WITH d AS (SELECT id, k, DATE '1970-01-01' + CAST(day AS INT) AS d FROM asked_relative),
       s AS (SELECT *, year(d) AS y, month(d) AS m, CASE k WHEN 5 THEN 3 WHEN 6 THEN 6 WHEN 7 THEN 9 WHEN 8 THEN 12 END AS f FROM d),
       e AS (SELECT *, CASE WHEN (f = 12 AND m > 2) OR (f < 12 AND m > f + 2) THEN y ELSE y - 1 END AS over_year FROM s),
       r AS (SELECT id, CAST(CASE k WHEN 0 THEN d WHEN 1 THEN d - 1 WHEN 2 THEN CAST(date_trunc('week', d) AS DATE) - 7 WHEN 3 THEN CAST(date_trunc('month', d) - INTERVAL 1 MONTH AS DATE)
                      WHEN 4 THEN make_date(y - 1, 1, 1) ELSE make_date(CASE WHEN f = 12 THEN over_year - 1 ELSE over_year END, f, 1) END AS DATE) AS a,
             CAST(CASE k WHEN 0 THEN d WHEN 1 THEN d - 1 WHEN 2 THEN CAST(date_trunc('week', d) AS DATE) - 1 WHEN 3 THEN CAST(date_trunc('month', d) AS DATE) - 1
                      WHEN 4 THEN make_date(y - 1, 12, 31) ELSE CAST(make_date(over_year, CASE WHEN f = 12 THEN 3 ELSE f + 3 END % 12 + CASE WHEN f = 9 THEN 12 ELSE 0 END, 1) - 1 AS DATE) END AS DATE) AS b FROM e)
       SELECT id, 'chat' AS rest, epoch_ms(CAST(a AS TIMESTAMP)) AS a, epoch_ms(CAST(b AS TIMESTAMP)) + 86399999 AS b FROM r""",
    "asked_relative",
)

# ---- types, persons, places
TYPES = ("captures d'écran", "selfie", "screen shots", "autoportraits", "photo")
NO = "CASE WHEN negated THEN 'no ' ELSE '' END"
KIND = "split_part('captures d''écran|selfie|screen shots|autoportraits|photo', '|', CAST(k + 1 AS INT))"


def typed(i, k, negated, name):
    p = qp.parse(f"{'no ' if negated else ''}{TYPES[k]} {name}", TODAY)
    return i, p.text, p.kind and p.kind.media_type, p.kind and p.kind.negated


register(
    "extract_type",
    over("asked_words", "id k negated name", typed, "id long, rest string, kind long, negated boolean"),
    f"""SELECT id, CASE WHEN k = 4 THEN {NO} || 'photo ' ELSE '' END || replace(name, '_', ' ') AS rest, CAST(CASE k WHEN 0 THEN 5 WHEN 1 THEN 2 WHEN 2 THEN 5 WHEN 3 THEN 2 END AS BIGINT) AS kind,
        CASE WHEN k < 4 THEN negated END AS negated FROM asked_words""",
    "asked_words",
)
NATIONS = [f"NATION_{k}" for k in range(25)]


def asked(lead: str, name: str) -> str:
    return f"chien {lead.strip()} {name.lower()} plage"


def with_person(i, lead, name):
    p = qp.parse(asked(lead, name), TODAY, persons=[qp.Person(k, n) for k, n in enumerate(NATIONS)])
    return i, p.text, ",".join(f"{x.id}{'-' if x.negated else '+'}" for x in p.persons)


register("extract_persons", over("asked_words", "id lead name", with_person, "id long, rest string, persons string"), "SELECT id, 'chien plage' AS rest, CAST(n AS VARCHAR) || CASE WHEN negated THEN '-' ELSE '+' END AS persons FROM asked_words", "asked_words")
register(
    "extract_persons_only",
    over("asked_words", "id name", lambda i, name: (lambda r: (i, r[1], r[0][0].id if r[0] else None))(qp.extract_persons(f"photo with {name} 2020", [qp.Person(k, n) for k, n in enumerate(NATIONS) if k % 5])), "id long, rest string, person long"),
    "SELECT id, CASE WHEN n % 5 = 0 THEN 'photo with ' || replace(name, '_', ' ') || ' 2020' ELSE 'photo 2020' END AS rest, CASE WHEN n % 5 <> 0 THEN n END AS person FROM asked_words",
    "asked_words",
)
CITIES = qp.city_phrases(qp.City(f"Ville {k}", float(k), -float(k), (n,)) for k, n in enumerate(NATIONS))
register(
    "extract_city",
    over("asked_words", "id lead name", lambda i, lead, name: (lambda p: (i, p.text, p.place and p.place.label, p.place and p.place.latitude, p.place and p.place.negated))(qp.parse(asked(lead, name), TODAY, CITIES)), "id long, rest string, city string, latitude double, negated boolean"),
    "SELECT id, 'chien plage' AS rest, 'Ville ' || CAST(n AS VARCHAR) AS city, CAST(n AS DOUBLE) AS latitude, negated FROM asked_words",
    "asked_words",
)
COUNTRIES = qp.country_phrases(qp.Country(chr(65 + k) + "X", (n,)) for k, n in enumerate(NATIONS))
register(
    "extract_country",
    over("asked_words", "id lead name", lambda i, lead, name: (lambda p: (i, p.text, p.country and p.country.code, p.country and p.country.negated))(qp.parse(asked(lead, name), TODAY, countries=COUNTRIES)), "id long, rest string, code string, negated boolean"),
    "SELECT id, 'chien plage' AS rest, chr(CAST(65 + n AS INT)) || 'X' AS code, negated FROM asked_words",
    "asked_words",
)
register(
    "consume_with_negation",
    over("asked_words", "id lead name", lambda i, lead, name: (lambda p: (i, p.text, p.place and p.place.source))(qp.parse(asked(lead, name), TODAY, CITIES)), "id long, rest string, source string"),
    "SELECT id, 'chien plage' AS rest, trim(lead) || ' ' || replace(lower(name), '_', ' ') AS source FROM asked_words",
    "asked_words",
)


def whole(i, k, negated, lead, name):
    """A query with a person, a type, a date and a place, and one of free text."""
    q = f"{TYPES[k]} {'without' if negated else 'with'} bob 05/2024 {lead} {name}" if k < 4 else f"un {name} chat"
    p = qp.parse(q, TODAY, CITIES if k < 4 else (), [qp.Person(1, "Bob Martin"), qp.Person(2, "Alice")])
    return i, p.text, p.filtered, p.kind and p.kind.media_type, p.dates and p.dates.start_ms, p.place and p.place.label, p.persons[0].negated if p.persons else None


register(
    "parse_query",
    over("asked_words", "id k negated lead name", whole, "id long, rest string, filtered boolean, kind long, a long, city string, without boolean"),
    """SELECT id, CASE WHEN k < 4 THEN '' ELSE 'un ' || replace(name, '_', ' ') || ' chat' END AS rest, k < 4 AS filtered, CAST(CASE k WHEN 0 THEN 5 WHEN 1 THEN 2 WHEN 2 THEN 5 WHEN 3 THEN 2 END AS BIGINT) AS kind,
       CASE WHEN k < 4 THEN 1714521600000 END AS a, CASE WHEN k < 4 THEN 'Ville ' || CAST(n AS VARCHAR) END AS city, CASE WHEN k < 4 THEN negated END AS without FROM asked_words""",
    "asked_words",
)
