"""Place queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import photos as ph
from . import register

register("city_count", lambda g: g.cities.agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM cities", "cities")
register(
    "nearest_city",
    lambda g: geo.nearest_city(g.photos, g.cities).select("id", "city_id", "city_name", "country_code", F.round("distance_km", 6).alias("distance_km")),
    """WITH p AS (SELECT p.id, c.id AS city_id, c.name, c.country_code, p.latitude AS a, p.longitude AS b, c.latitude AS x, c.longitude AS y,
              CASE WHEN c.latitude BETWEEN p.latitude - 0.01 AND p.latitude + 0.01 AND c.longitude BETWEEN p.longitude - 0.01 AND p.longitude + 0.01 THEN 0
                   WHEN c.latitude BETWEEN p.latitude - 0.1 AND p.latitude + 0.1 AND c.longitude BETWEEN p.longitude - 0.1 AND p.longitude + 0.1 THEN 1 ELSE 2 END AS step
            FROM photos p JOIN cities c ON c.latitude BETWEEN p.latitude - 1 AND p.latitude + 1 AND c.longitude BETWEEN p.longitude - 1 AND p.longitude + 1),
       r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY step, (x - a) * (x - a) + (y - b) * (y - b), city_id) AS k FROM p),
       d AS (SELECT id, city_id, name AS city_name, country_code, sqrt(((y - b) * cos(radians((a + x) / 2))) ** 2 + (x - a) ** 2) * 111 AS km FROM r WHERE k = 1)
       SELECT id, city_id, city_name, country_code, round(km, 6) AS distance_km FROM d WHERE km <= 100""",
    "photos cities",
)
register("approx_distance_km", lambda g: g.photos.filter("latitude is not null").select("id", F.round(geo.approx_distance_km(F.col("latitude"), F.col("longitude"), F.lit(48.85), F.lit(2.35)), 6).alias("km")), "SELECT id, round(sqrt(((2.35 - longitude) * cos(radians((latitude + 48.85) / 2))) ** 2 + (48.85 - latitude) ** 2) * 111, 6) AS km FROM photos WHERE latitude IS NOT NULL")
register(
    "geo_radius_to_box",
    lambda g: g.cities.select("id", *(F.round(c, 9).alias(n) for c, n in zip(geo.box_columns(F.col("latitude"), F.col("longitude")), ("min_lat", "max_lat", "min_lon", "max_lon"), strict=True))),
    """SELECT id, round(latitude - 25.0 / 111, 9) AS min_lat, round(latitude + 25.0 / 111, 9) AS max_lat, round(longitude - 25.0 / (111 * greatest(cos(radians(latitude)), 0.01)), 9) AS min_lon,
       round(longitude + 25.0 / (111 * greatest(cos(radians(latitude)), 0.01)), 9) AS max_lon FROM cities""",
    "cities",
)
register("location_label", lambda g: g.cities.select("id", geo.location_label(F.col("name"), F.col("country_code")).alias("label")), "SELECT id, name || ', ' || country_code AS label FROM cities", "cities")
register("known_countries", lambda g: g.photos.filter(ph.visible()).select(geo.country_suffix(F.col("location_name")).alias("code")).filter("code is not null").distinct(), "SELECT DISTINCT trim(split_part(location_name, ',', -1)) AS code FROM photos WHERE NOT is_hidden AND location_name IS NOT NULL")
register("split_location", lambda g: g.photos.filter("location_name is not null").select("id", geo.split_location(F.col("location_name"))[0].alias("name"), geo.split_location(F.col("location_name"))[1].alias("rest")), "SELECT id, trim(split_part(location_name, ',', 1)) AS name, trim(substr(location_name, instr(location_name, ',') + 1)) AS rest FROM photos WHERE location_name IS NOT NULL")
register(
    "known_cities",
    lambda g: ph.known_cities(g.photos, g.cities, g.aliases).select("id", "name", F.array_join("aliases", "|").alias("aliases")),
    """WITH l AS (SELECT DISTINCT trim(split_part(location_name, ',', 1)) AS n, trim(split_part(location_name, ',', 2)) AS c FROM photos WHERE NOT is_hidden AND location_name IS NOT NULL),
       r AS (SELECT ct.id, ct.name, row_number() OVER (PARTITION BY ct.name, ct.country_code ORDER BY coalesce(population, -1) DESC, id) AS k FROM cities ct JOIN l ON l.n = ct.name AND l.c = ct.country_code),
       a AS (SELECT city_id, string_agg(alias, '|' ORDER BY alias) AS aliases FROM city_aliases GROUP BY city_id)
       SELECT r.id, r.name, coalesce(a.aliases, '') AS aliases FROM r LEFT JOIN a ON a.city_id = r.id WHERE k = 1""",
    "photos cities city_aliases",
)
