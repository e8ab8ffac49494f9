"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """(v, comp) for each vertex of ``edges`` (a, b): comp is the smallest vertex that links reach.

    Smallest labels travel along links, then every label jumps to its own label,
    until nothing changes. Each round's table is kept in the shared folder; nothing but
    a count of changes comes to the driver. A hub's links are pre-aggregated.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct())
    at = cut(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("comp")))
    while True:
        over = both.join(at.select(F.col("v").alias("b"), "comp"), "b").groupBy(F.col("a").alias("v")).agg(F.min("comp").alias("near"))
        low = at.join(over, "v").select("v", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        jump = low.join(at.select(F.col("v").alias("comp"), F.col("comp").alias("far")), "comp")
        new = cut(jump.select("v", "was", F.least("comp", "far").alias("comp")))
        changed = new.filter("comp <> was").limit(1).count()
        at = new.select("v", "comp")
        if not changed:
            return at
