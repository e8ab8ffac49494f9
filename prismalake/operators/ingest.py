"""Set differences between a library and what is on the device."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pairs(live: DataFrame, stored: DataFrame, how: str) -> DataFrame:
    old = stored.select(F.col("file_path"), *(F.col(c).alias(f"old_{c}") for c in ("id", "file_size", "file_last_modified")), F.lit(True).alias("known"))
    return live.join(old, "file_path", how)


def _differs(*cols: str) -> Column:
    out = F.lit(False)
    for c in cols:
        out = out | ~F.col(c).eqNullSafe(F.col(f"old_{c}"))
    return out


def photos_to_upsert(live: DataFrame, stored: DataFrame) -> DataFrame:
    """Live rows of new paths, or whose id, size or time differs."""
    found = _pairs(live, stored, "left")
    return found.filter(F.col("known").isNull() | _differs("id", "file_size", "file_last_modified")).select(*live.columns)


def modified_ids(live: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored ids of known paths whose size or time differs; another id alone doesn't count."""
    return _pairs(live, stored, "inner").filter(_differs("file_size", "file_last_modified")).select(F.col("old_id").alias("id"))


def paths_to_delete(stored: DataFrame, live: DataFrame | None) -> DataFrame:
    """Stored paths that are gone; none if the source couldn't be listed (None)."""
    return stored.select("file_path").limit(0) if live is None else stored.select("file_path").join(live.select("file_path"), "file_path", "left_anti")


def sync_status(live: DataFrame, stored: DataFrame) -> DataFrame:
    """(file_path, status): new, modified or same."""
    found = _pairs(live, stored, "left")
    status = F.when(F.col("known").isNull(), "new").when(_differs("id", "file_size", "file_last_modified"), "modified").otherwise("same")
    return found.select("file_path", status.alias("status"))
