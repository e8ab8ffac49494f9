"""Python functions over whole columns, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def map_rows(rows: DataFrame, load: Callable[[], Callable[..., tuple]], schema: str) -> DataFrame:
    """A function applied to the columns of each row; it returns the columns of ``schema``.

    ``load`` makes the function once a task (and opens what it needs). Narrow, a
    batch in memory at a time.
    """
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = load()
        for b in batches:
            got = [one(*row) for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(zip(*got, strict=True), out, strict=True)], schema=out)

    return rows.mapInArrow(run, schema)
