"""Dates: taken dates, day ranges, timeline buckets and headers."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve_date_taken(raw: Column, modified: Column) -> Column:
    return F.when(raw > 0, raw).otherwise(modified)


def date_range_ms(first: date, last: date, zone: str = "UTC") -> tuple[int, int]:
    """Milliseconds from the start of the first day to the last one before the day after the last."""
    start = lambda d: int(datetime(d.year, d.month, d.day, tzinfo=ZoneInfo(zone)).timestamp() * 1000)
    return start(first), start(last + timedelta(days=1)) - 1


def thresholds(now: datetime, zone: str = "UTC", first_weekday: int = 0) -> dict[str, int]:
    """Starts of today, this week (``first_weekday``: 0 Monday), this month and this year in milliseconds."""
    today = now.astimezone(ZoneInfo(zone)).date()
    week = today - timedelta(days=(today.weekday() - first_weekday) % 7)
    return {k: date_range_ms(d, d, zone)[0] for k, d in (("today", today), ("week", week), ("month", today.replace(day=1)), ("year", today.replace(month=1, day=1)))}


def timeline_bucket(taken: Column, now: datetime, zone: str = "UTC", first_weekday: int = 0) -> Column:
    """Title of the bucket of a time in ms: today, week, month, a month of this year, or a month with its year; null for null.

    Months are formatted in ``zone`` whatever the session's is.
    """
    t = thresholds(now, zone, first_weekday)
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.timestamp_millis(taken).cast("timestamp_ntz")) if zone != "UTC" else F.timestamp_millis(taken)
    return (
        F.when(taken.isNull(), F.lit(None).cast("string"))
        .when(taken >= t["today"], "Today")
        .when(taken >= t["week"], "This week")
        .when(taken >= t["month"], "This month")
        .when(taken >= t["year"], F.initcap(F.date_format(local, "MMMM")))
        .otherwise(F.initcap(F.date_format(local, "MMMM yyyy")))
    )


def timeline_headers(photos: DataFrame, bucket: Column) -> DataFrame:
    """Visible photos in timeline order with the header that stands before each, null if none does.

    A header stands where the bucket differs from that of the photo before. The
    photo before is found by a range sort into buckets of time, not by one
    global window: buckets are computed per row, and only the first photo of a
    bucket (by date descending, id) carries its header. Buckets are contiguous
    in time, so both say the same. Undated photos come last, without headers.
    """
    rows = photos.withColumn("bucket", bucket)
    heads = rows.filter("bucket is not null").groupBy("bucket").agg(F.min(F.struct((-F.col("date_taken")).alias("t"), "id")).alias("h"))
    heads = heads.select(F.col("bucket").alias("header"), F.col("h.id").alias("hid"))
    return rows.join(heads, rows["id"] == heads["hid"], "left").drop("hid").orderBy(F.desc_nulls_last("date_taken"), "id")


def viewer_index(photos: DataFrame, start_id: int) -> DataFrame:
    """Place of a photo in the timeline of ``photos``, 0 if it isn't there: a count of what stands before it."""
    start = photos.filter(F.col("id") == start_id).select(F.col("date_taken").alias("sd"), F.col("id").alias("si"))
    later = F.coalesce(F.col("date_taken") > F.col("sd"), F.col("date_taken").isNotNull() & F.col("sd").isNull())
    tie = F.col("date_taken").eqNullSafe(F.col("sd")) & (F.col("id") < F.col("si"))
    return photos.join(F.broadcast(start)).agg(F.count_if(later | tie).alias("start_index"))

