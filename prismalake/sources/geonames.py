"""City tables from tab-separated gazetteer files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import normalize_column


def _lines(spark: SparkSession, path: str, least: int) -> DataFrame:
    """Lines as arrays of columns (no quoting), short ones out, with their place in the file."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    rows = spark.read.text(path).select(F.split("value", "\t").alias("c"), place.alias("line"))
    return rows.filter(F.size("c") >= least)


def geonames_cities(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, alternates, latitude, longitude, country_code, population); the last of rows with one id counts."""
    c = F.col("c")
    rows = _lines(spark, path, 15).select("line", c[0].try_cast("long").alias("id"), c[1].alias("name"), c[3].alias("alternates"), c[4].try_cast("double").alias("latitude"), c[5].try_cast("double").alias("longitude"), c[8].alias("country_code"), F.when(c[14] != "", c[14].try_cast("int")).alias("population"))
    names = [x for x in rows.columns if x != "line"]
    last = rows.filter("id is not null").groupBy("id").agg(F.max_by(F.struct(*names), "line").alias("r"))
    return last.select("r.*")


def geonames_aliases(spark: SparkSession, path: str, cities: DataFrame, languages: Iterable[str] = ("en",), drop_informal: bool = True) -> DataFrame:
    """(city_id, alias, line): names of known cities in the languages, colloquial and historic ones out if asked."""
    c = F.col("c")
    rows = _lines(spark, path, 4).select("line", c[1].try_cast("long").alias("city_id"), c[2].alias("lang"), F.trim(c[3]).alias("alias"), F.get(c, F.lit(6)).alias("colloquial"), F.get(c, F.lit(7)).alias("historic"))
    keep = F.col("lang").isin(*languages) & (F.col("alias") != "")
    if drop_informal:
        keep = keep & ~F.coalesce(F.col("colloquial") == "1", F.lit(False)) & ~F.coalesce(F.col("historic") == "1", F.lit(False))
    known = cities.select(F.col("id").alias("city_id"))
    return rows.filter(keep).join(known, "city_id", "left_semi").select("city_id", "alias", "line")


def fallback_aliases(cities: DataFrame) -> DataFrame:
    """(city_id, alias, line) from the alternates column: names whose letters are all below U+0250."""
    rows = cities.select(F.col("id").alias("city_id"), F.posexplode(F.split("alternates", ",")).alias("line", "alias")).withColumn("alias", F.trim("alias"))
    return rows.filter((F.col("alias") != "") & ~F.col("alias").rlike(r"[\p{L}&&[^\x{0000}-\x{024F}]]"))


def alias_dedup(aliases: DataFrame, cities: DataFrame) -> DataFrame:
    """First alias of each (city, normalised alias), without those equal to the city's own normalised name."""
    norm = normalize_column()
    rows = aliases.withColumn("n", norm("alias"))
    first = rows.withColumn("k", F.row_number().over(W.partitionBy("city_id", "n").orderBy("line", "alias"))).filter("k = 1")
    own = cities.select(F.col("id").alias("city_id"), norm("name").alias("own"))
    return first.join(own, "city_id", "left").filter(~F.col("n").eqNullSafe(F.col("own"))).select("city_id", "alias")


def import_cities(cities: DataFrame, aliases: DataFrame, folder: str, version: str) -> bool:
    """Write both tables and a version mark; False if that version is there already."""
    spark = cities.sparkSession
    mark = f"{folder}/version"
    path = spark._jvm.org.apache.hadoop.fs.Path(mark)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) and spark.read.text(mark).first().value == version:
        return False
    cities.write.mode("overwrite").parquet(f"{folder}/cities")
    aliases.write.mode("overwrite").parquet(f"{folder}/city_aliases")
    spark.createDataFrame([(version,)], "value string").write.mode("overwrite").text(mark)
    return True


def open_member(names: Iterable[tuple[str, int]], archive: str) -> str:
    """Of an archive's (name, size) members that whose stem is the archive's, else the largest."""
    stem = lambda n: n.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    members = list(names)
    return next((n for n, _ in members if stem(n) == stem(archive)), max(members, key=lambda m: m[1])[0])
