"""Shared plumbing of the training-data operators.

Nothing here swallows errors; operators read the session's
``spark.checkpoint.dir`` (a folder all executors share) whenever they cut
lineage, so a lost executor never takes the only copy of a result with it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir

#: What counts as white space between words; every other character belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of an Arrow batch, whatever the number and length of its texts; one longer text is a batch of its own.
BATCH_BYTES = 4 << 20
_BYTES_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def few(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``df`` computed once, with a broadcast hint if it has at most ``most`` (narrow) rows."""
    done = cut(df)
    return F.broadcast(done) if done.count() <= most else done


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of the session's Arrow batches; the same bound for every operator, as plans run later than they are built."""
    now = re.match(r"(\d+)b?$", spark.conf.get(_BYTES_CONF))
    if now is None or int(now[1]) > BATCH_BYTES:
        spark.conf.set(_BYTES_CONF, str(BATCH_BYTES))


def map_rows(df: DataFrame, rows: Callable[[list[list]], list[list]], schema: str) -> DataFrame:
    """Apply ``rows`` (lists of input columns -> lists of output columns) to each Arrow batch."""
    small_batches(df.sparkSession)
    types = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = rows([c.to_pylist() for c in b.columns])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, type=t.type) for v, t in zip(out, types, strict=True)], schema=types
                )

    return df.mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    parsed = StructType.fromDDL(ddl) if hasattr(StructType, "fromDDL") else spark.createDataFrame([], ddl).schema
    return to_arrow_schema(parsed)


def n_words(text: str) -> "F.Column":
    """Number of words of a text column; null counts as 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
