"""Gazetteer and model imports, caches and policies."""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.sql import functions as F

from ..functions import faces as fc
from ..functions import tokenizers as tk
from ..functions.rowwise import map_rows
from ..plans import actions
from ..plans.search import Recent, Sitting
from ..shared import shared_dir
from ..sources import geonames, models
from ..streaming import sync
from . import register


def written(g, lines) -> str:
    """A text column as files in the folder that executors share."""
    path = f"{shared_dir(g.spark)}/lines-{uuid.uuid4().hex}"
    lines.write.text(path)
    return path


def city_lines(g):
    c = g.cities
    text = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    empty = F.lit("")
    cols = [text(F.col("id")), F.col("name"), empty, F.concat(F.lit("Old "), F.col("name"), F.lit(", Париж ,")), text(F.col("latitude")), text(F.col("longitude")), empty, empty, F.col("country_code"), *[empty] * 5, text(F.col("population"))]
    return c.select(F.concat_ws("\t", *cols).alias("value")).unionByName(g.spark.sql("SELECT 'too\tshort' AS value"))


def parsed_cities(g):
    return geonames.geonames_cities(g.spark, written(g, city_lines(g)))


def alias_lines(g):
    rows = g.aliases.select(F.concat_ws("\t", F.lit("1"), F.col("city_id").cast("string"), F.lit("en"), F.col("alias"), F.lit(""), F.lit(""), F.lit(""), F.lit("")).alias("value"))
    odd = g.cities.filter("population is not null").select(F.concat_ws("\t", F.lit("1"), F.col("id").cast("string"), F.lit("en"), F.concat(F.lit("Slang "), "name"), F.lit(""), F.lit(""), F.lit("1"), F.lit("")).alias("value"))
    foreign = g.cities.select(F.concat_ws("\t", F.lit("1"), F.col("id").cast("string"), F.lit("xx"), F.col("name"), F.lit(""), F.lit(""), F.lit(""), F.lit("")).alias("value"))
    same = g.cities.select(F.concat_ws("\t", F.lit("1"), F.col("id").cast("string"), F.lit("en"), F.upper("name"), F.lit(""), F.lit(""), F.lit(""), F.lit("")).alias("value"))
    return rows.unionByName(odd).unionByName(foreign).unionByName(same)


def parsed_aliases(g):
    return geonames.geonames_aliases(g.spark, written(g, alias_lines(g)), g.cities)


register("geonames_cities", lambda g: parsed_cities(g).select("id", "name", "country_code", "latitude", "longitude", "population"), "SELECT id, name, country_code, latitude, longitude, population FROM cities", "cities")
register("geonames_aliases", lambda g: parsed_aliases(g).select("city_id", "alias"), "SELECT city_id, alias FROM city_aliases WHERE city_id IN (SELECT id FROM cities) UNION ALL SELECT id, upper(name) FROM cities", "cities city_aliases")
register("geonames_fallback_aliases", lambda g: geonames.fallback_aliases(parsed_cities(g)).select("city_id", "alias"), "SELECT id AS city_id, 'Old ' || name AS alias FROM cities", "cities")
register("alias_dedup", lambda g: geonames.alias_dedup(parsed_aliases(g), g.cities), "SELECT CAST(city_id AS BIGINT) AS city_id, alias FROM city_aliases WHERE city_id IN (SELECT id FROM cities)", "city_aliases cities")


def imported(g):
    folder = written(g, g.spark.sql("SELECT '' AS value")) + "-cities"
    first = geonames.import_cities(g.cities, g.aliases, folder, "1")
    again = geonames.import_cities(g.cities.limit(0), g.aliases, folder, "1")
    return g.spark.read.parquet(f"{folder}/cities").select("id", F.lit(first).alias("first"), F.lit(again).alias("again"))


register("cities_import", imported, "SELECT id, true AS first, false AS again FROM cities", "cities")
register("write_cities_sqlite", lambda g: imported(g).select("id"), "SELECT id FROM cities", "cities")


def each(g, table: str, columns: str):
    return g.spark.read.parquet(f"{g.dir}/{table}.parquet").select(*columns.split())


def rowwise(name: str, table: str, columns: str, one, schema: str, sql: str) -> None:
    """A query that applies ``one`` to the columns of each row of a table."""
    register(name, lambda g: map_rows(each(g, table, columns), lambda: one, schema), sql, "photos")


def member(k: int, name: str) -> tuple:
    files = [("readme.txt", 9), *([(f"x/{name}.txt", 5)] if k % 2 else [("a/largest.csv", 50)])]
    return k, geonames.open_member(files, f"/tmp/{name}.zip")


rowwise("open_member", "nation", "n_nationkey n_name", member, "id long, member string", "SELECT CAST(n_nationkey AS BIGINT) AS id, CASE WHEN n_nationkey % 2 = 1 THEN 'x/' || n_name || '.txt' ELSE 'a/largest.csv' END AS member FROM nation")

GOOD = {"type": "face_detection", "name": "D", "files": {"detector": "d.onnx"}, "image_size": 640}
CHANGES = ({}, {"name": " "}, {"type": "x"}, {"files": {}}, {"image_size": -1}, {"tokenizer": "x"}, {"type": "clip"})


def config(k: int, name: str) -> tuple:
    """The name and size of a model read back, or why it is refused."""
    try:
        m = models.parse_model_config(json.dumps(GOOD | {"name": name, "image_size": 64 + k} | CHANGES[k % 7]))
        return k, m.name, m.image_size
    except models.ModelError as e:
        return k, e.reason, None


rowwise("parse_model_config", "customer", "c_custkey c_name", config, "id long, got string, size long", "SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN c_name ELSE 'invalid_config' END AS got, CASE WHEN c_custkey % 7 = 0 THEN 64 + c_custkey END AS size FROM customer")
LANGUAGES = ("EN", "fr", "De", "es", "IT")
rowwise("supports_language", "customer", "c_custkey", lambda k: (k, models.parse_model_config(json.dumps(GOOD | {"languages": LANGUAGES[: k % 5 + 1]})).supports_language(LANGUAGES[k % 3].swapcase())), "id long, yes boolean", "SELECT c_custkey AS id, c_custkey % 3 <= c_custkey % 5 AS yes FROM customer")
rowwise("parse_vocab_json", "customer", "c_custkey c_name", lambda k, n: (lambda v: (k, len(v), v[n] + v["b"]))(tk.parse_vocab_json(json.dumps({n: k, "b": "2", "é": 3}))), "id long, n long, s long", "SELECT c_custkey AS id, CAST(3 AS BIGINT) AS n, c_custkey + 2 AS s FROM customer")
rowwise("parse_merges", "customer", "c_custkey c_name", lambda k, n: (lambda m: (k, len(m), m[(n, str(k))]))(tk.parse_merges(["#version", *["a b"] * (k % 2), "bad", f"{n} {k}", "x y z", "c d"])), "id long, n long, rank long", "SELECT c_custkey AS id, 2 + c_custkey % 2 AS n, c_custkey % 2 AS rank FROM customer")


def tokenizer_file(k: int, name: str) -> tuple:
    vocab, merges = tk.parse_model_json(json.dumps({"model": {"vocab": {name: k, "b": 7}, "merges": [f"{name} b", ["b", name], "bad"] if k % 2 else [["b", "c"]]}}))
    return vocab, merges


rowwise("parse_model_vocab", "customer", "c_custkey c_name", lambda k, n: (k, sum(tokenizer_file(k, n)[0].values())), "id long, s long", "SELECT c_custkey AS id, c_custkey + 7 AS s FROM customer")
rowwise("parse_model_merges", "customer", "c_custkey c_name", lambda k, n: (lambda m: (k, len(m), m.get(("b", n))))(tokenizer_file(k, n)[1]), "id long, n long, rank long", "SELECT c_custkey AS id, 1 + c_custkey % 2 AS n, CASE WHEN c_custkey % 2 = 1 THEN CAST(1 AS BIGINT) END AS rank FROM customer")
rowwise("parse_unigram_json", "customer", "c_custkey c_name", lambda k, n: (lambda v: (k, v[1], v[0][0][0], v[0][0][1]))(tk.parse_unigram_json(json.dumps({"model": {"vocab": [[n, -k], ["b", 0]], **({"unk_id": k} if k % 2 else {})}}))), "id long, unk long, piece string, score double", "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 1 THEN c_custkey ELSE 0 END AS unk, c_name AS piece, CAST(-c_custkey AS DOUBLE) AS score FROM customer")


def attempts(k: int) -> tuple:
    """Tries of a step that fails ``k % 6`` times, with an error that is never tried again for some."""
    tried = []

    def step() -> None:
        tried.append(1)
        if len(tried) <= k % 6:
            raise OSError if k % 4 == 3 else ValueError

    try:
        sync.with_retries(step, never=(OSError,))
        done = True
    except (OSError, ValueError):
        done = False
    return k, len(tried), done


rowwise("retry_policy", "customer", "c_custkey", attempts, "id long, tries long, done boolean", "SELECT c_custkey AS id, CASE WHEN c_custkey % 6 = 0 THEN CAST(1 AS BIGINT) WHEN c_custkey % 4 = 3 THEN 1 ELSE least(c_custkey % 6 + 1, 4) END AS tries, c_custkey % 6 = 0 OR (c_custkey % 4 <> 3 AND c_custkey % 6 <= 3) AS done FROM customer")


def histories(g):
    """What each user did, in order (a user's steps are few)."""
    steps = g.view("steps").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("n", "event_type"))).alias("s"))
    return steps.select("user_id", F.transform("s", lambda x: x.event_type).alias("s"))


def kept(size: int):
    def one(user: int, steps: list[str]) -> tuple:
        cache = Recent(size)
        for n, k in enumerate(steps):
            if k in cache:
                cache[k]
            else:
                cache[k] = n
        return user, "|".join(cache)

    return one


LRU = "WITH l AS (SELECT user_id, event_type, max(n) AS n FROM steps GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC) AS k FROM l) SELECT user_id, string_agg(event_type, '|' ORDER BY n) AS kept FROM r WHERE k <= {} GROUP BY user_id"
register("session_cache", lambda g: map_rows(histories(g), lambda: kept(4), "user_id long, kept string"), LRU.format(4), "steps")
register("translation_cache", lambda g: map_rows(histories(g), lambda: kept(3), "user_id long, kept string"), LRU.format(3), "steps")


def sitting(user: int, steps: list[str]) -> tuple:
    """A search box: purchases submit a query, views and errors take filters off, clicks a person, signups bring a late result."""
    s, late = Sitting(), 0
    for k in steps:
        if k == "purchase":
            s.submit("q")
        elif k == "view":
            s.remove_filter("dates")
        elif k == "error":
            s.remove_filter("place")
        elif k == "click":
            s.remove_person(s.generation)
        else:
            late += not s.arrived(s.generation - 1, k)
            s.arrived(s.generation, k)
    return user, s.generation, len(s.use), len(s.removed_persons), late


register(
    "query_session",
    lambda g: map_rows(histories(g), lambda: sitting, "user_id long, generation long, filters long, persons long, late long"),
    """WITH p AS (SELECT user_id, coalesce(max(n) FILTER (event_type = 'purchase'), 0) AS p FROM steps GROUP BY user_id)
       SELECT user_id, count(*) FILTER (event_type <> 'signup') AS generation,
              4 - CAST(bool_or(n > p AND event_type = 'view') AS BIGINT) - CAST(bool_or(n > p AND event_type = 'error') AS BIGINT) AS filters,
              count(*) FILTER (n > p AND event_type = 'click') AS persons, count(*) FILTER (event_type = 'signup') AS late
       FROM steps JOIN p USING (user_id) GROUP BY user_id""",
    "steps",
)


def scans(user: int, steps: list[str]) -> tuple:
    """Views ask for a gallery scan, purchases for a full one, errors cancel: how many scans started, and what runs at the end."""
    s, started = actions.Scans(), 0
    for k in steps:
        if k == "error":
            s.cancel()
        elif k in ("view", "purchase"):
            started += s.start("gallery" if k == "view" else "full")
    return user, started, s.running


register(
    "cancel_scans",
    lambda g: map_rows(histories(g), lambda: scans, "user_id long, started long, running string"),
    """WITH s AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY n) AS before FROM steps WHERE event_type IN ('view', 'purchase', 'error')),
       e AS (SELECT *, event_type = 'purchase' OR (event_type = 'view' AND coalesce(before, 'error') = 'error') AS starts FROM s),
       f AS (SELECT user_id, count(*) FILTER (starts) AS started, max_by(event_type, n) AS last, max_by(event_type, n) FILTER (starts) AS run FROM e GROUP BY user_id)
       SELECT u.user_id, coalesce(started, 0) AS started, CASE WHEN last <> 'error' THEN CASE WHEN run = 'view' THEN 'gallery' ELSE 'full' END END AS running
       FROM (SELECT DISTINCT user_id FROM steps) u LEFT JOIN f USING (user_id)""",
    "steps",
)


def pixel(k: int) -> np.ndarray:
    return np.array([[[k % 256, k * 7 % 256, k * 13 % 256]]], np.uint8)


RGB = "c_custkey % 256 AS r, c_custkey * 7 % 256 AS g, c_custkey * 13 % 256 AS b"
rowwise("image_tensor", "customer", "c_custkey", lambda k: (k, *(round(float(x), 3) for x in fc.image_tensor(pixel(k), bgr=k % 2 == 1)[:, 0, 0])), "id long, x double, y double, z double", f"WITH p AS (SELECT c_custkey AS id, {RGB} FROM customer) SELECT id, round((CASE WHEN id % 2 = 1 THEN b ELSE r END / 255 - 0.5) / 0.5, 3) AS x, round((g / 255 - 0.5) / 0.5, 3) AS y, round((CASE WHEN id % 2 = 1 THEN r ELSE b END / 255 - 0.5) / 0.5, 3) AS z FROM p")
rowwise("grayscale", "customer", "c_custkey", lambda k: (k, round(float(fc.grayscale(pixel(k))[0, 0]), 6)), "id long, luma double", f"WITH p AS (SELECT c_custkey AS id, {RGB} FROM customer) SELECT id, round(CAST(0.299 * r + 0.587 * g + 0.114 * b AS DOUBLE), 6) AS luma FROM p")
