"""Places: boxes, distances, location labels, nearest city."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import ascii_lower

KM_PER_DEGREE = 111.0
RADIUS_KM = 25.0
#: Half sides of the squares searched for a city, in degrees, and the distance beyond which there is none.
DELTAS = (0.01, 0.1, 1.0)
MAX_CITY_KM = 100.0


def box_of_radius(lat: float, lon: float, radius_km: float = RADIUS_KM) -> tuple[float, float, float, float]:
    """(min lat, max lat, min lon, max lon) around a point; no wrap at the antimeridian."""
    dlat = radius_km / KM_PER_DEGREE
    dlon = radius_km / (KM_PER_DEGREE * max(math.cos(math.radians(lat)), 0.01))
    return lat - dlat, lat + dlat, lon - dlon, lon + dlon


def box_columns(lat: Column, lon: Column, radius_km: float = RADIUS_KM) -> list[Column]:
    dlat = F.lit(radius_km / KM_PER_DEGREE)
    dlon = F.lit(radius_km) / (F.lit(KM_PER_DEGREE) * F.greatest(F.cos(F.radians(lat)), F.lit(0.01)))
    return [(lat - dlat).alias("min_lat"), (lat + dlat).alias("max_lat"), (lon - dlon).alias("min_lon"), (lon + dlon).alias("max_lon")]


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """True or false, never null: both coordinates known and inside."""
    return lat.isNotNull() & lon.isNotNull() & lat.between(box[0], box[1]) & lon.between(box[2], box[3])


def approx_distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular distance at the mean latitude."""
    dx = (lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    dy = lat2 - lat1
    return F.sqrt(dx * dx + dy * dy) * KM_PER_DEGREE


def location_label(name: Column, country: Column) -> Column:
    return F.concat(name, F.lit(", "), country)


def in_country(location: Column, code: str) -> Column:
    """The label ends in ``, CC`` in either case; false for unknown places."""
    return F.coalesce(ascii_lower(location).endswith(f", {code}".lower()), F.lit(False))


def country_suffix(location: Column) -> Column:
    """Two letters behind the last comma, else null."""
    code = F.when(F.instr(location, ",") > 0, F.trim(F.substring_index(location, ",", -1)))
    return F.when(F.length(code) == 2, code)


def split_location(location: Column) -> tuple[Column, Column]:
    """Name before the first comma, rest behind it (empty if there is none)."""
    at = F.instr(location, ",")
    rest = F.when(at > 0, F.trim(F.substring(location, at + 1, F.length(location)))).otherwise("")
    return F.trim(F.substring_index(location, ",", 1)), rest


def nearest_city(points: DataFrame, cities: DataFrame, key: str = "id") -> DataFrame:
    """(key, city_id, city_name, country_code, distance_km) for each point with a city in reach.

    The nearest city by squared degrees inside the smallest of three squares that
    holds one; dropped if it is over 100 km away. Points and cities meet by
    one-degree cells of which a city fills nine, so the join is an equi-join,
    and each point keeps one candidate through a pre-aggregated minimum.
    """
    widest = max(DELTAS)
    near = F.sequence(F.lit(-1), F.lit(1))
    p = points.filter("latitude is not null and longitude is not null").select(F.col(key).alias("k"), F.col("latitude").alias("plat"), F.col("longitude").alias("plon"), F.floor(F.col("latitude") / widest).alias("cy"), F.floor(F.col("longitude") / widest).alias("cx"))
    c = cities.select("id", "name", "country_code", F.col("latitude").alias("clat"), F.col("longitude").alias("clon"))
    c = c.withColumn("dy", F.explode(near)).withColumn("dx", F.explode(near))
    c = c.select("id", "name", "country_code", "clat", "clon", (F.floor(F.col("clat") / widest) + F.col("dy")).alias("cy"), (F.floor(F.col("clon") / widest) + F.col("dx")).alias("cx"))
    within = lambda d: F.col("clat").between(F.col("plat") - d, F.col("plat") + d) & F.col("clon").between(F.col("plon") - d, F.col("plon") + d)
    step = F.when(within(DELTAS[0]), 0).when(within(DELTAS[1]), 1).when(within(DELTAS[2]), 2)
    pairs = p.join(c, ["cy", "cx"]).withColumn("step", step).filter("step is not null")
    d2 = (F.col("clat") - F.col("plat")) * (F.col("clat") - F.col("plat")) + (F.col("clon") - F.col("plon")) * (F.col("clon") - F.col("plon"))
    best = pairs.groupBy("k", "plat", "plon").agg(F.min(F.struct("step", d2.alias("d2"), "id", "name", "country_code", "clat", "clon")).alias("b"))
    km = approx_distance_km(F.col("plat"), F.col("plon"), F.col("b.clat"), F.col("b.clon"))
    return best.select(F.col("k").alias(key), F.col("b.id").alias("city_id"), F.col("b.name").alias("city_name"), F.col("b.country_code").alias("country_code"), km.alias("distance_km")).filter(F.col("distance_km") <= MAX_CITY_KM)
