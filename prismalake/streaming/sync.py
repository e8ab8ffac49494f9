"""Incremental work: listing batches into the library, and queues of missing analyses."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranking import global_rank, kept
from ..functions.rowwise import map_rows
from ..operators import ingest, mutate
from ..operators import photos as ph

RETRIES = 3


@dataclass
class Tables:
    """Folders of the tables that a sync changes, each whole or in ``buckets`` folders by the photo's id, so that a batch rewrites those it touches."""

    photos: str
    analyses: str
    faces: str
    buckets: int = 0

    def keys(self) -> tuple[tuple[str, str], ...]:
        return (self.analyses, "photo_id"), (self.faces, "photo_id"), (self.photos, "id")

    def bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(max(self.buckets, 1))).cast("int")

    def read(self, spark: SparkSession, path: str) -> DataFrame:
        return spark.read.parquet(path).drop(BUCKET) if self.buckets else spark.read.parquet(path)

    def write(self, df: DataFrame, path: str, key: str) -> None:
        """A new table."""
        if self.buckets:
            df.withColumn(BUCKET, self.bucket(key)).repartition(BUCKET).write.partitionBy(BUCKET).parquet(path)
        else:
            df.write.parquet(path)

    def recover(self, spark: SparkSession) -> None:
        for path, _ in self.keys():
            for k in range(self.buckets or 1):
                mutate.recover(spark, f"{path}/{BUCKET}={k}" if self.buckets else path)

    def change(self, path: str, key: str, touched: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Swap the buckets of the ``touched`` keys: ``change`` maps their rows and those of ``touched`` to the new rows."""
        spark = touched.sparkSession
        if not self.buckets:
            mutate.swap(change(spark.read.parquet(path), touched), path)
            return
        whole = self.read(spark, path)
        of = touched.withColumn(BUCKET, self.bucket(key))
        for k in sorted(r[0] for r in of.select(BUCKET).distinct().collect()):  # at most ``buckets``
            part = f"{path}/{BUCKET}={k}"
            fs, _, _, now = mutate.places(spark, part)
            old = spark.read.parquet(part) if fs.exists(now) else whole.limit(0)
            mutate.swap(change(old, of.filter(F.col(BUCKET) == k).drop(BUCKET)), part)


BUCKET = "bucket"


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    return mutate.delete_keys(rows, gone, gone.columns)


def apply_batch(batch: DataFrame, tables: Tables) -> None:
    """One batch of listing rows (photo columns): changed photos lose analyses and faces, then rows are upserted.

    Applying a batch twice changes nothing more, so a repeated micro-batch is safe.
    """
    spark = batch.sparkSession
    tables.recover(spark)
    stored = tables.read(spark, tables.photos)
    batch = mutate.one_of_each(batch, ["id"], ["file_last_modified", "file_size", "file_path"])
    # kept, as the tables that they are worked out from change one after another
    new = kept(ingest.photos_to_upsert(batch, stored).select(*stored.columns))
    # a path that comes back under another id replaces its old row
    moved = kept(stored.join(new.select("file_path", F.col("id").alias("__new")), "file_path").filter(F.col("id") != F.col("__new")).select("id"))
    changed = ingest.modified_ids(batch, stored).unionByName(moved).distinct()
    gone = kept(changed.select(F.col("id").alias("photo_id")))
    for path, key in tables.keys()[:2]:
        tables.change(path, key, gone, _without)
    tables.change(tables.photos, "id", moved, _without)
    tables.change(tables.photos, "id", new, lambda rows, more: mutate.upsert(rows, more, ["id"]))


def sync_stream(listing: DataFrame, tables: Tables, checkpoint: str):
    """A streaming listing into the library: all files that are there now, each exactly once by the checkpoint."""
    return listing.writeStream.foreachBatch(lambda df, _: apply_batch(df, tables)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sync(listing: DataFrame, live: DataFrame | None, tables: Tables) -> None:
    """A whole sync: upserts, then deletes with their children unless the live set is unknown."""
    spark = listing.sparkSession
    apply_batch(listing, tables)
    stored = tables.read(spark, tables.photos)
    gone = ingest.paths_to_delete(stored, live)
    ids = kept(stored.join(gone, "file_path", "left_semi").select("id"))
    for path, key in tables.keys():
        tables.change(path, key, ids.select(F.col("id").alias(key)), _without)


ANALYSIS = "photo_id long, analysis_type string, model_name string, text_result string, embedding array<float>, embedding_dim int, created_at long, duration_ms long"


def run_analysis(photos: DataFrame, analyses: DataFrame, kind: str, model: str, load: Callable[[], Callable[[str], Sequence[float]]], now: int) -> DataFrame:
    """Rows for visible photos that lack an analysis: an embedding, or ``error: ...`` and none where the model failed.

    ``load`` opens a session once a task; its callable maps a path to a vector.
    """
    queue = ph.missing_analysis(photos, analyses, kind, model).select("id", "file_path")

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        encode = load()

        def one(path: str) -> tuple[str | None, list[float] | None]:
            try:
                return None, [float(x) for x in encode(path)]
            except Exception as e:  # a photo that can't be analysed is recorded, not retried for ever
                return f"error: {e}", None

        for b in batches:
            got = [one(p) for p in b["file_path"]]
            yield pd.DataFrame({"photo_id": b["id"], "analysis_type": kind, "model_name": model, "text_result": [t for t, _ in got], "embedding": [v for _, v in got], "embedding_dim": pd.array([None if v is None else len(v) for _, v in got], "Int32"), "created_at": now, "duration_ms": pd.array([0] * len(b), "Int64")})

    return queue.mapInPandas(run, ANALYSIS)


FOUND = "box_left double, box_top double, box_right double, box_bottom double, confidence double, embedding array<float>"


def index_faces(photos: DataFrame, analyses: DataFrame, faces: DataFrame, model: str, load: Callable[[], Callable[[str], Sequence[dict]]], now: int) -> tuple[DataFrame, DataFrame]:
    """(analyses, faces) after a face analysis of the visible photos that lack one.

    ``load`` opens the models once a task; its callable maps a path to found
    faces (box_*, confidence, embedding). The faces of an analysed photo are
    deleted and its new ones inserted, with ids behind the largest; the analysis
    says how many, or ``error: ...`` with the faces left as they were.
    """
    queue = ph.missing_analysis(photos, analyses, "faces", model).select(F.col("id").alias("photo_id"), "file_path")

    def opened() -> Callable[[int, str], tuple]:
        analyse = load()

        def one(photo: int, path: str) -> tuple:
            try:
                return photo, None, [dict(f) for f in analyse(path)]
            except Exception as e:  # a photo that can't be analysed is recorded, not retried for ever
                return photo, f"error: {str(e)[:200]}", []

        return one

    got = map_rows(queue, opened, f"photo_id long, error string, found array<struct<{', '.join(x.replace(' ', ':', 1) for x in FOUND.split(', '))}>>").persist()
    result = F.coalesce("error", F.size("found").cast("string"))
    rows = got.select("photo_id", F.lit("faces").alias("analysis_type"), F.lit(model).alias("model_name"), result.alias("text_result"), F.lit(now).cast("long").alias("created_at"))
    for c, kind in analyses.dtypes:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast(kind))
    done = got.filter("error is null").select("photo_id")
    new = got.select("photo_id", F.posexplode("found").alias("__pos", "__face")).select("photo_id", "__pos", "__face.*")
    top = faces.agg(F.coalesce(F.max("id"), F.lit(0)).alias("t")).first().t
    new = global_rank(new, [F.asc("photo_id"), F.asc("__pos")], "__rank").withColumn("id", (F.col("__rank") + top).cast("long"))
    for c, kind in faces.dtypes:
        new = new.withColumn(c, F.col(c).cast(kind) if c in new.columns else F.lit(None).cast(kind))
    kept = mutate.delete_keys(faces, done, ["photo_id"])
    return mutate.upsert(analyses, rows, ["photo_id", "analysis_type", "model_name"]), kept.unionByName(new.select(*faces.columns))


def reindex(analyses: DataFrame, kind: str) -> DataFrame:
    """Analyses without those of a type, so that its queue holds every photo again."""
    return mutate.delete_where(analyses, F.col("analysis_type") == kind)


def with_retries(step: Callable[[], None], never: tuple[type[Exception], ...] = (), retries: int = RETRIES) -> None:
    """Run a step, again up to ``retries`` times after a failure, except after those of the kinds in ``never``."""
    for attempt in range(retries + 1):
        try:
            return step()
        except never:
            raise
        except Exception:
            if attempt == retries:
                raise


#: Steps of a full scan and of a gallery scan, in order.
FULL_SCAN = ("discovery", "cities", "metadata", "clip", "ai", "faces", "cleanup")
GALLERY_SCAN = ("discovery", "metadata", "clip", "faces", "cleanup")


def run_scan(steps: dict[str, Callable[[], None]], order: Sequence[str] = FULL_SCAN) -> list[str]:
    """Run the steps that are given, in order; a failing one ends the chain."""
    done = []
    for name in order:
        if name in steps:
            with_retries(steps[name])
            done.append(name)
    return done
