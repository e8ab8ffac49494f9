"""Places in a global order without one global window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..shared import shared_dir


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the folder that all executors share; Spark's cleaner may remove it when nothing refers to it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Rows with their 1-based place in a total order.

    Rows are dealt by range and numbered inside each range; what stands before a
    range is the sum of the earlier ranges' counts, a row a partition. The dealt
    rows are kept first, since a repeated sampling could deal them otherwise.
    """
    dealt = kept(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__part", before.alias("__before"))
    inside = F.row_number().over(W.partitionBy("__part").orderBy(*order))
    return dealt.withColumn("__in", inside).join(F.broadcast(starts), "__part").withColumn(name, (F.col("__before") + F.col("__in")).cast("long")).drop("__part", "__in", "__before")
