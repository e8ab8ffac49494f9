"""A photo library derived from the analytic test tables.

Each view is one SELECT that Spark and DuckDB both run; only the epoch function
and the way a table is named differ.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

#: {epoch} becomes the milliseconds of e.ts (a timestamp without zone), {t:x} a table, {str} the text type.
VIEWS: dict[str, str] = {
    "photos": """
        SELECT d.doc_id AS id, concat('content://', CAST(d.doc_id AS {str})) AS file_path, concat('IMG_', CAST(d.doc_id AS {str}), '.jpg') AS file_name,
               1700000000000 + d.doc_id * 1000 AS file_last_modified,
               CASE WHEN d.doc_id % 11 = 0 THEN '' ELSE concat('DCIM/', d.source) END AS folder_path,
               CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE concat('DCIM/', d.source) END AS relative_path,
               CASE WHEN d.doc_id % 13 = 0 THEN NULL ELSE {epoch} END AS date_taken,
               1690000000000 + d.doc_id * 500 AS date_added,
               CASE WHEN d.doc_id % 19 = 0 THEN NULL ELSE CAST(600 + d.n_chars % 3000 AS INT) END AS width,
               CASE WHEN d.doc_id % 19 = 0 THEN NULL WHEN d.doc_id % 6 = 0 THEN CAST(600 + d.n_chars % 3000 AS INT) ELSE CAST(600 + (d.doc_id * 31) % 2000 AS INT) END AS height,
               CAST((d.doc_id % 4) * 90 AS INT) AS orientation,
               CASE WHEN d.doc_id % 5 = 0 THEN NULL ELSE CAST((d.doc_id * 37) % 18000 AS DOUBLE) / 100 - 90 END AS latitude,
               CASE WHEN d.doc_id % 5 = 0 THEN NULL ELSE CAST((d.doc_id * 91) % 36000 AS DOUBLE) / 100 - 180 END AS longitude,
               CASE WHEN d.doc_id % 7 = 0 THEN NULL ELSE concat(n.n_name, ', C', CAST(n.n_regionkey AS {str})) END AS location_name,
               CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE 'Maker' END AS camera_make,
               CASE WHEN d.doc_id % 3 = 0 THEN NULL WHEN d.doc_id % 4 = 0 THEN 'X Front' ELSE 'X Back' END AS camera_model,
               d.n_chars * 100 AS file_size, 'image/jpeg' AS mime_type, CAST(d.n_chars % 9 AS INT) AS media_type,
               d.doc_id % 10 = 0 AS is_favorite, d.doc_id % 17 = 0 AS is_hidden, d.doc_id % 4 <> 0 AS is_metadata_extracted
        FROM {t:documents} d LEFT JOIN {t:events} e ON e.event_id = d.doc_id LEFT JOIN {t:nation} n ON n.n_nationkey = d.doc_id % 25""",
    "persons": """
        SELECT CAST(label AS BIGINT) AS id, CASE WHEN label % 3 = 0 THEN NULL ELSE concat('Person ', CAST(label AS {str})) END AS name,
               1600000000000 + CAST(label AS BIGINT) AS created_at, CAST((label * 3) % 7 AS INT) AS photo_count, label = 9 AS is_hidden
        FROM (SELECT DISTINCT label FROM {t:embeddings}) x""",
    "faces": """
        SELECT vec_id AS id, (vec_id * 7) % n AS photo_id, CAST(label AS BIGINT) AS person_id, embedding,
               CASE vec_id % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'manual' WHEN 2 THEN 'pending' ELSE 'ignored' END AS assignment_type,
               CASE WHEN vec_id % 4 = 3 THEN 'irrelevant' END AS exclusion_reason,
               CAST((vec_id * 13) % 100 AS DOUBLE) / 100 AS confidence, vec_id % 10 = 0 AS is_primary,
               1.0 + CAST(vec_id % 5 AS DOUBLE) / 10 AS weight, CAST(NULL AS DOUBLE) AS assignment_confidence, CAST(NULL AS BIGINT) AS assigned_at,
               CAST((vec_id * 17) % 60 AS DOUBLE) / 100 AS box_left, CAST((vec_id * 11) % 50 AS DOUBLE) / 100 AS box_top,
               CAST((vec_id * 17) % 60 + 10 + vec_id % 20 AS DOUBLE) / 100 AS box_right, CAST((vec_id * 11) % 50 + 15 + vec_id % 25 AS DOUBLE) / 100 AS box_bottom
        FROM {t:embeddings} CROSS JOIN (SELECT count(*) AS n FROM {t:documents}) c""",
    "photo_analyses": """
        SELECT vec_id AS photo_id, 'clip_embedding' AS analysis_type, 'm1' AS model_name, CAST(NULL AS {str}) AS text_result,
               CASE WHEN vec_id % 50 = 1 THEN NULL ELSE embedding END AS embedding, 64 AS embedding_dim, 1700000000000 + vec_id AS created_at
        FROM {t:embeddings} WHERE vec_id % 3 <> 0""",
    "cities": """
        SELECT c_custkey AS id, c_name AS name, concat('C', CAST(c_nationkey % 5 AS {str})) AS country_code,
               CAST((c_custkey * 53) % 18000 AS DOUBLE) / 100 - 90 AS latitude, CAST((c_custkey * 113) % 36000 AS DOUBLE) / 100 - 180 AS longitude,
               CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE CAST((c_custkey * 977) % 100000 AS INT) END AS population
        FROM {t:customer}
        UNION ALL
        SELECT 1000000 + n_nationkey, n_name, concat('C', CAST(n_regionkey AS {str})), CAST(n_nationkey AS DOUBLE), CAST(n_nationkey AS DOUBLE) * 2, CAST(n_nationkey * 10 AS INT)
        FROM {t:nation} WHERE n_nationkey % 4 <> 3""",
    "city_aliases": """
        SELECT 1000000 + n_nationkey AS city_id, concat('Old ', n_name) AS alias FROM {t:nation} WHERE n_nationkey % 2 = 0
        UNION ALL SELECT 1000000 + n_nationkey, concat('New ', n_name) FROM {t:nation} WHERE n_nationkey % 3 = 0""",
    "albums": """
        SELECT CAST(n_nationkey AS BIGINT) AS id, concat('Album ', n_name) AS name,
               CASE n_nationkey % 4 WHEN 0 THEN 'manual' WHEN 1 THEN 'folder' WHEN 2 THEN 'auto_event' ELSE 'autoXplace' END AS album_type,
               CASE WHEN n_nationkey % 4 = 1 THEN concat('DCIM/src', CAST(n_nationkey AS {str})) END AS folder_path,
               CASE WHEN n_nationkey % 3 = 0 THEN NULL WHEN n_nationkey % 7 = 1 THEN 99999999 ELSE CAST(n_nationkey * 3 AS BIGINT) END AS cover_photo_id,
               CAST(n_nationkey % 6 AS INT) AS photo_count, 1650000000000 + n_nationkey AS created_at
        FROM {t:nation}""",
    "album_photos": """
        SELECT DISTINCT l_orderkey % 30 AS album_id, l_partkey % n AS photo_id, CAST(1660000000000 AS BIGINT) AS added_at
        FROM {t:lineitem} CROSS JOIN (SELECT count(*) AS n FROM {t:documents}) c""",
    "analysis_log": """
        SELECT event_id AS id, user_id AS photo_id, event_type AS analysis_type, concat('m', CAST(event_id % 3 AS {str})) AS model_used, {epoch} AS started_at,
               CASE WHEN event_id % 7 = 0 THEN NULL ELSE {epoch} + 1000 END AS completed_at,
               CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 5 <> 0 END AS success,
               CASE WHEN event_id % 5 = 0 AND event_id % 7 <> 0 THEN 'failed' END AS error_message
        FROM {t:events} e""",
    "photo_hashes": """
        SELECT doc_id AS photo_id, substring(md5(text), 1, 2) AS phash, substring(md5(text), 3, 2) AS dhash, md5(text) AS file_hash FROM {t:documents}""",
    "ai_models": """
        SELECT CAST(n_nationkey AS BIGINT) AS id, CASE n_regionkey WHEN 0 THEN 'clip' WHEN 1 THEN 'translation' WHEN 2 THEN 'face_detection' WHEN 3 THEN 'face_embedding' ELSE 'ocr' END AS model_type,
               n_name AS model_name, n_nationkey % 5 = 0 AS is_active, n_nationkey % 7 = 0 AS is_builtin, 1640000000000 + n_nationkey AS added_at
        FROM {t:nation}""",
    "asked_dates": """
        SELECT o_orderkey AS id, o_orderkey % 12 + 1 AS m, 1950 + o_orderkey % 120 AS y, o_orderkey % 4 AS k,
               CASE o_orderkey % 4
                 WHEN 0 THEN concat('plage ', split_part('janvier,février,mars,avril,mai,juin,juillet,août,septembre,octobre,novembre,décembre', ',', CAST(o_orderkey % 12 + 1 AS INT)), ' ', CAST(1950 + o_orderkey % 120 AS {str}))
                 WHEN 1 THEN concat('beach not in ', split_part('January,February,March,April,May,June,July,August,September,October,November,December', ',', CAST(o_orderkey % 12 + 1 AS INT)), ' ', CAST(1950 + o_orderkey % 120 AS {str}), ' sun')
                 WHEN 2 THEN concat(CAST(o_orderkey % 12 + 1 AS {str}), '/', CAST(1950 + o_orderkey % 120 AS {str}))
                 ELSE concat('x ', CAST(1950 + o_orderkey % 120 AS {str}), ' 13/2020') END AS q
        FROM {t:orders}""",
    "asked_relative": """
        SELECT o_orderkey AS id, 18262 + o_orderkey % 1500 AS day, o_orderkey % 9 AS k,
               concat('chat ', split_part('aujourd''hui|hier|la semaine dernière|last month|an dernier|last spring|l''été dernier|last fall|hiver dernier', '|', CAST(o_orderkey % 9 + 1 AS INT))) AS q
        FROM {t:orders}""",
    "asked_words": """
        SELECT o_orderkey AS id, o_orderkey % 5 AS k, o_orderkey % 25 AS n, o_orderkey % 2 = 0 AS negated, concat('NATION_', CAST(o_orderkey % 25 AS {str})) AS name,
               CASE WHEN o_orderkey % 2 = 0 THEN split_part('pas à|sans |not in|except near|sauf vers', '|', CAST(o_orderkey % 5 + 1 AS INT)) ELSE split_part('à|en|in|near|vers', '|', CAST(o_orderkey % 5 + 1 AS INT)) END AS lead
        FROM {t:orders}""",
    "steps": """
        SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM {t:events}""",
    "live_media": """
        SELECT CASE WHEN doc_id % 23 = 0 THEN doc_id + 5000000 ELSE doc_id END AS id,
               concat('content://', CAST(CASE WHEN doc_id % 29 = 0 THEN doc_id + 9000000 ELSE doc_id END AS {str})) AS file_path,
               CASE WHEN doc_id % 31 = 0 THEN n_chars * 100 + 1 ELSE n_chars * 100 END AS file_size,
               CASE WHEN doc_id % 37 = 0 THEN 1700000000001 + doc_id * 1000 ELSE 1700000000000 + doc_id * 1000 END AS file_last_modified
        FROM {t:documents} WHERE doc_id % 41 <> 0""",
}


def _filled(sql: str, table, text: str, epoch: str) -> str:
    out = sql.replace("{str}", text).replace("{epoch}", epoch)
    while "{t:" in out:
        a = out.index("{t:")
        b = out.index("}", a)
        out = out[:a] + table(out[a + 3 : b]) + out[b + 1 :]
    return out


def duckdb_with(*names: str) -> str:
    """WITH clause of the named views for DuckDB."""
    return "WITH " + ", ".join(f"{n} AS ({_filled(VIEWS[n], lambda t: t, 'VARCHAR', '(epoch_us(e.ts) // 1000)')})" for n in names)


class Gallery:
    """The views of one folder of tables as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def view(self, name: str) -> DataFrame:
        sql = _filled(VIEWS[name], lambda t: f"parquet.`{self.dir}/{t}.parquet`", "STRING", "unix_millis(CAST(e.ts AS TIMESTAMP))")
        return self.spark.sql(sql)

    photos = cached_property(lambda self: self.view("photos"))
    persons = cached_property(lambda self: self.view("persons"))
    faces = cached_property(lambda self: self.view("faces"))
    analyses = cached_property(lambda self: self.view("photo_analyses"))
    cities = cached_property(lambda self: self.view("cities"))
    aliases = cached_property(lambda self: self.view("city_aliases"))
    albums = cached_property(lambda self: self.view("albums"))
    album_photos = cached_property(lambda self: self.view("album_photos"))
    log = cached_property(lambda self: self.view("analysis_log"))
    hashes = cached_property(lambda self: self.view("photo_hashes"))
    models = cached_property(lambda self: self.view("ai_models"))
    live = cached_property(lambda self: self.view("live_media"))
