"""Embeddings: codecs, normalisation, similarity, exact top-k."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def encode_blob(vector: Sequence[float]) -> bytes:
    """Little-endian float32."""
    return np.asarray(vector, "<f4").tobytes()


def decode_blob(blob: bytes | None, dim: int | None = None) -> list[float] | None:
    if blob is None:
        return None
    v = np.frombuffer(blob, "<f4")
    if dim is not None and len(v) < dim:
        raise ValueError("the blob is shorter than its dimension")
    return v[:dim].tolist()


def decode_column():
    """binary -> array<float>, as an Arrow UDF for the import boundary."""

    @F.pandas_udf("array<float>")
    def run(s):
        return s.map(decode_blob, na_action="ignore")

    return run


def encode_column():
    """array<float> -> binary."""

    @F.pandas_udf("binary")
    def run(s):
        return s.map(encode_blob, na_action="ignore")

    return run


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalize_l2(v: Column) -> Column:
    """Unit length (norm in float64, result in float32); zero vectors stay."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: (x / n).cast("float"))).otherwise(v)


def dot(a: Column, b: Column, exact: bool = True) -> Column:
    """Dot product, in float64 or as a sequential float32 sum; null for unequal sizes."""
    kind = "double" if exact else "float"
    pairs = F.zip_with(a, b, lambda x, y: x.cast(kind) * y.cast(kind))
    total = F.aggregate(pairs, F.lit(0.0).cast(kind), lambda s, x: (s + x).cast(kind))
    return F.when(F.size(a) == F.size(b), total)


def literal_vector(query: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)).cast("float") for x in query))


def scored(rows: DataFrame, query: Sequence[float], id_col: str = "photo_id", vector: str = "embedding", native: bool = True) -> DataFrame:
    """(id, score) of rows whose dimension is the query's; nulls are skipped.

    ``native`` keeps the product in the JVM; otherwise Arrow batches go through
    one matrix product each, which pays for long vectors and many rows.
    """
    rows = rows.select(F.col(id_col).alias("id"), F.col(vector).alias("v")).filter(F.size("v") == len(query))
    if native:
        return rows.select("id", dot(F.col("v"), literal_vector(query)).alias("score"))
    q = np.asarray(query, np.float64)

    @F.pandas_udf("double")
    def product(s):
        import pandas as pd

        return pd.Series(np.stack(s.to_numpy()).astype(np.float64) @ q) if len(s) else pd.Series([], dtype="float64")

    return rows.select("id", product("v").alias("score"))


def top_k(rows: DataFrame, k: int, score: str = "score", id_col: str = "id") -> DataFrame:
    """The k best rows, smaller ids first on ties; none for k <= 0."""
    return rows.orderBy(F.desc(score), F.asc(id_col)).limit(max(k, 0))


def weighted_centroid(rows: DataFrame, key: str, vector: str, weight: str) -> DataFrame:
    """(key, centroid): unit vector of the weighted sum of each group's vectors.

    Components are summed in parallel by (key, place), so a group of any size is
    pre-aggregated before it is shuffled. Groups of mixed dimensions, or whose
    weights add up to 0 or less, raise; null vectors are left out.
    """
    at = rows.filter(F.col(vector).isNotNull()).select(F.col(key).alias("__g"), F.size(vector).alias("dim"), F.col(weight).cast("double").alias("w"), F.posexplode(vector).alias("i", "x"))
    sums = at.groupBy("__g", "i").agg(F.sum(F.col("w") * F.col("x").cast("double")).alias("s"), F.sum("w").alias("w"), F.min("dim").alias("lo"), F.max("dim").alias("hi"))
    ok = F.when(F.col("lo") != F.col("hi"), F.raise_error(F.lit("embeddings of several dimensions"))).when(F.col("w") <= 0, F.raise_error(F.lit("weights must add up to more than 0"))).otherwise(F.col("s"))
    parts = sums.withColumn("s", ok).groupBy("__g").agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("p"))
    total = F.transform("p", lambda x: x.s)
    size = F.sqrt(F.aggregate(total, F.lit(0.0), lambda a, x: a + x * x))
    return parts.select(F.col("__g").alias(key), F.when(size > 0, F.transform(total, lambda x: x / size)).otherwise(total).alias("centroid"))
