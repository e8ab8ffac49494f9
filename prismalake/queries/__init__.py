"""Every library operator as a query over the test tables, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans.gallery import Gallery, duckdb_with

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, build: Callable[[Gallery], DataFrame], sql: str | None = None, views: str = "photos") -> None:
    """A query ``build(gallery)``; ``sql`` is what follows a WITH clause of the space-separated ``views``."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(Gallery(spark, sf_dir))

    run.__name__ = name
    QUERIES[name] = run
    if sql is not None:
        head, recursive = duckdb_with(*views.split()), "WITH RECURSIVE "
        if sql.startswith(recursive):
            text = f"{recursive}{head[5:]}, {sql[len(recursive):]}"
        else:
            text = f"{head}{', ' + sql[5:] if sql.startswith('WITH ') else ' ' + sql}"
        ORACLE_SQL[name] = text


from . import albums, composite, imports, media, mutations, parser, people, photos, places, scans, vectors  # noqa: E402, F401
