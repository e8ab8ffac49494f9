"""Library actions, batch steps, model surroundings and exports."""

from __future__ import annotations

import uuid
from datetime import date

import numpy as np
from pyspark.sql import functions as F

from ..functions import faces as fc
from ..functions import tokenizers as tk
from ..functions import vectors as vc
from ..functions.rowwise import map_rows
from ..operators import people
from ..operators import photos as ph
from ..plans import actions, inference, search
from ..plans import query_parser as qp
from ..shared import shared_dir
from ..sources import exports
from ..sources.models import ModelConfig, activation
from ..streaming import sync
from . import register
from .mutations import with_centroids
from .vectors import ALIKE, CENT, E, JANUARY, NX, NY, PITCH, X0, X1, Y0, Y1, frozen, marks, query_of

# ---- incremental steps
DONE = "SELECT photo_id FROM photo_analyses WHERE analysis_type = 'clip_embedding' AND model_name = 'm1'"
QUEUE = f"FROM photos WHERE NOT is_hidden AND id NOT IN ({DONE})"


def fake_encoder():
    """Stands for a model: a vector of two, and a failure for paths that end in 7."""

    def encode(path: str) -> list[float]:
        if path.endswith("7"):
            raise OSError("broken")
        return [float(len(path)), 1.0]

    return encode


def indexed(g, kind: str = "clip_embedding", model: str = "m1"):
    return sync.run_analysis(g.photos, g.analyses, kind, model, fake_encoder, 5).select("photo_id", "text_result", F.size("embedding").alias("dim"))


BATCH = "SELECT id AS photo_id, CASE WHEN id % 10 = 7 THEN 'error: broken' END AS text_result, CASE WHEN id % 10 <> 7 THEN 2 END AS dim "
register("clip_index_batch", indexed, BATCH + QUEUE, "photos photo_analyses")
register("clip_index_initial", lambda g: ph.missing_analysis(g.photos, g.analyses, "clip_embedding", "m1").select("id"), f"SELECT id {QUEUE}", "photos photo_analyses")
register("clip_reindex", lambda g: ph.missing_analysis(g.photos, sync.reindex(g.analyses, "clip_embedding"), "clip_embedding", "m1").select("id"), "SELECT id FROM photos WHERE NOT is_hidden")
# ---- searches
LIB = lambda g: search.Library(g.photos, g.faces, g.analyses, g.persons, g.cities, g.aliases)
FACES_OF_4 = "SELECT photo_id FROM faces WHERE person_id = 4 AND assignment_type IN ('auto', 'manual')"
PARSED = qp.Parsed("img", qp.Dates(1704067200000, 1706745599999, False, "january 2024"), persons=(qp.WithPerson(4, "Person 4", True, "not person 4"),))
register("run_filters", lambda g: search.run_filters(LIB(g), PARSED).select("id"), f"SELECT id FROM photos WHERE NOT is_hidden AND {JANUARY} AND lower(file_name) LIKE '%img%' AND id NOT IN ({FACES_OF_4})", "photos faces")
register("remove_filter", lambda g: search.search(LIB(g), "img january 2024 not person 4", date(2026, 7, 6), use=frozenset(), removed_persons=[4]).photos.select("id"), "SELECT id FROM photos WHERE NOT is_hidden AND lower(file_name) LIKE '%img%'")
NOWHERE = qp.Parsed("sunset", place=qp.Place(89.9, 0.0, 1.0, "IMG", False, "IMG"))
register("search_fallback_semantic", lambda g: search.search_parsed(LIB(g), NOWHERE, lambda _: query_of(g), floor=-1.0).photos.select("id"), f"SELECT photo_id AS id FROM photo_analyses WHERE embedding IS NOT NULL AND photo_id IN (SELECT id FROM photos WHERE NOT is_hidden) ORDER BY round(list_inner_product(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 5)), 12) DESC, id LIMIT 200", "photo_analyses photos")
EMPTY_PLACE = qp.Parsed("", place=NOWHERE.place)
register("search_fallback_text", lambda g: search.search_parsed(LIB(g), EMPTY_PLACE).photos.select("id"), "SELECT id FROM photos WHERE NOT is_hidden")


def nations(g, *columns):
    return g.spark.read.parquet(f"{g.dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("k"), *columns)


def missing(g):
    """Searches by an encoder that knows a language or not, with a translator that knows some words only."""
    rows, lib = [], LIB(g)
    for r in g.spark.read.parquet(f"{g.dir}/region.parquet").select(F.col("r_regionkey").cast("long").alias("k"), "r_name").collect():  # one search a region: five
        known, translated = r.k % 2 == 0, r.k % 3 == 0
        got = search.search(lib, r.r_name, date(2026, 7, 6), translate=lambda t, ok=translated: f"{t} x" if ok else None, encoder_knows_language=known)
        rows.append((r.k, got.translation_missing, got.translated))
    return g.spark.createDataFrame(rows, "k long, missing boolean, translated string")


register("translation_missing_flag", missing, "SELECT CAST(r_regionkey AS BIGINT) AS k, r_regionkey % 2 = 1 AND r_regionkey % 3 <> 0 AS missing, CASE WHEN r_regionkey % 3 = 0 THEN array_to_string(regexp_extract_all(r_name, '[A-Za-z0-9]+'), ' ') || ' x' END AS translated FROM region")


def settings_of(k: int, name: str) -> actions.Settings:
    return actions.Settings(
        included_folders=frozenset((name,)), cursors={name: k, "old": 7}, query_language=("system", "fr", "de")[k % 3], app_language=("en", "it")[k % 2],
        search_floor=k / 100 if k % 4 == 1 else None, show_scores=k % 7 == 6, threshold_high=0.9, show_hidden_people=True,
    )


K = "CAST(n_nationkey AS BIGINT) AS k"
LANGUAGE = "CASE n_nationkey % 3 WHEN 0 THEN CASE n_nationkey % 2 WHEN 0 THEN 'en' ELSE 'it' END WHEN 1 THEN 'fr' ELSE 'de' END"
settings = lambda one, schema: lambda g: map_rows(nations(g, "n_name"), lambda: one, schema)
register("query_language", settings(lambda k, n: (k, settings_of(k, n).language()), "k long, language string"), f"SELECT {K}, {LANGUAGE} AS language FROM nation")
register("similarity_floor", settings(lambda k, n: (k, settings_of(k, n).floor(0.06 if k % 5 == 0 else None)), "k long, floor double"), f"SELECT {K}, CASE WHEN n_nationkey % 7 = 6 THEN CAST('-inf' AS DOUBLE) WHEN n_nationkey % 4 = 1 THEN n_nationkey / 100 WHEN n_nationkey % 5 = 0 THEN CAST(0.06 AS DOUBLE) ELSE CAST(0.2 AS DOUBLE) END AS floor FROM nation")


def after_reset(k: int, name: str) -> tuple:
    s = actions.reset_settings(settings_of(k, name))
    return k, s.language(), s.threshold_high, s.show_hidden_people, s.floor(), ",".join(s.included_folders), s.cursors[name]


register("reset_settings", settings(after_reset, "k long, language string, high double, hidden boolean, floor double, folders string, since long"), f"SELECT {K}, CASE n_nationkey % 2 WHEN 0 THEN 'en' ELSE 'it' END AS language, CAST(0.45 AS DOUBLE) AS high, false AS hidden, CAST(0.2 AS DOUBLE) AS floor, n_name AS folders, CAST(n_nationkey AS BIGINT) AS since FROM nation")


def chosen(g):
    """The photos that a scan reads after another choice of folders: known ones from their cursor on, new ones from their beginning."""
    from ..sources.media import scan_since
    from .media import listing

    rows = listing(g)
    folders = [r.relative_path.rstrip("/") for r in rows.filter("relative_path is not null").select("relative_path").distinct().orderBy("relative_path").collect()]
    s = actions.Settings(included_folders=frozenset(folders[:2]), cursors=dict.fromkeys(folders[:2], 1700000100000))
    return scan_since(rows, dict(actions.apply_included_folders(s, frozenset(folders[1:])).cursors)).select("id")


register(
    "apply_included_folders", chosen,
    """WITH f AS (SELECT DISTINCT relative_path AS p FROM photos WHERE relative_path IS NOT NULL), r AS (SELECT p, row_number() OVER (ORDER BY p) AS k FROM f)
       SELECT id FROM photos JOIN r ON r.p = relative_path WHERE k > 2 OR (k = 2 AND file_last_modified // 1000 > 1700000100)""",
)
TABLES = ("photos", "persons", "faces", "albums", "cities", "ai_models")


def reset(g):
    after, _ = actions.reset_database(dict(zip(TABLES, (g.photos, g.persons, g.faces, g.albums, g.cities, g.models), strict=True)), actions.Settings())
    out = None
    for name, t in after.items():
        one = t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


register("reset_database", reset, "SELECT name, n FROM (VALUES ('photos', 0), ('persons', 0), ('faces', 0), ('albums', 0)) v(name, n) UNION ALL SELECT 'cities', count(*) FROM cities UNION ALL SELECT 'ai_models', count(*) FROM ai_models", "cities ai_models")

# ---- people
register("rename_person", lambda g: actions.rename_person(g.persons, 4, "  ada LOVE").select("id", "name"), "SELECT id, CASE WHEN id = 4 THEN 'Ada LOVE' ELSE name END AS name FROM persons", "persons")
register("name_group", lambda g: actions.name_group(with_centroids(g), g.faces, 3, "new name", 5)[0].select("id", "name"), "SELECT id, CASE WHEN id = 3 THEN 'New Name' ELSE name END AS name FROM persons", "persons")
register("name_face", lambda g: actions.name_face(with_centroids(g), g.faces, 6, "someone", 500, 5)[1].select("id", "person_id", "assignment_type"), "SELECT id, CASE WHEN id = 6 THEN 500 ELSE person_id END AS person_id, CASE WHEN id = 6 THEN 'manual' ELSE assignment_type END AS assignment_type FROM faces", "faces")


def accepted(g):
    """Persons and primary faces after two groups became one, with the centroid of all their faces."""
    persons, faces = people.merge_persons(with_centroids(g), g.faces, 1, 6, 5)
    primary = faces.filter("person_id = 1 and is_primary and assignment_type in ('auto', 'manual')").agg(F.max("id").alias("primary"))
    return persons.select("id", "photo_count", F.round(F.col("centroid_embedding")[2], 6).alias("x")).crossJoin(F.broadcast(primary))


register(
    "accept_merge", accepted,
    """WITH f AS (SELECT id, photo_id, weight, CAST(embedding AS DOUBLE[]) AS e FROM faces WHERE person_id IN (1, 6) AND assignment_type IN ('auto', 'manual')),
       u AS (SELECT unnest(e) * weight AS x, generate_subscripts(e, 1) AS i FROM f), s AS (SELECT i, sum(x) AS x FROM u GROUP BY i), n AS (SELECT list(x ORDER BY i) AS c, sqrt(sum(x * x)) AS n FROM s),
       m AS (SELECT f.id, round(list_inner_product(e, c) / n, 9) AS sim FROM f, n)
       SELECT p.id, CASE WHEN p.id = 1 THEN CAST((SELECT count(DISTINCT photo_id) FROM f) AS INT) ELSE p.photo_count END AS photo_count, CASE WHEN p.id = 1 THEN (SELECT round(c[3] / n, 6) FROM n) END AS x,
              (SELECT id FROM m ORDER BY sim DESC, id LIMIT 1) AS "primary" FROM persons p WHERE p.id <> 6""",
    "faces persons",
)
register("exclude_or_hide_target", lambda g: actions.exclude_or_hide(g.persons, g.faces, ("group", 2), False, "", 0, 5)[0].select("id", "is_hidden"), "SELECT id, id = 2 OR is_hidden AS is_hidden FROM persons", "persons")
register("exclude_group", lambda g: actions.exclude_or_hide(g.persons, g.faces, ("group", 2), True, "irrelevant", 0, 5)[0].select("id"), "SELECT id FROM persons WHERE id <> 2", "persons")


def remaining(g):
    """Questions left for sittings that have skipped 0, 2 and very many of them."""
    open_ = g.faces.agg(F.count_if(F.col("assignment_type") == "pending").alias("n")).first().n
    rows = [(k, actions.Session(skipped={("face", i) for i in range(k)}).remaining(open_)) for k in (0, 2, 100_000)]
    return g.spark.createDataFrame(rows, "skipped long, n long")


register("remaining_questions", remaining, "SELECT CAST(k AS BIGINT) AS skipped, greatest(n - k, 0) AS n FROM (SELECT count(*) AS n FROM faces WHERE assignment_type = 'pending') c, (VALUES (0), (2), (100000)) v(k)", "faces")


def suggested(g, dismissals: int):
    """The best merge to propose after as many dismissals in a sitting."""
    pairs = [(r.keep, r.merge, round(r.similarity, 6)) for r in people.merge_candidates(frozen(g), ALIKE).collect()]
    proposals, sitting, best = people.propose_merges(pairs), actions.Session(), None
    ids = [r.id for r in g.persons.select("id").collect()]
    for _ in range(dismissals + 1):
        if best is not None:
            sitting.dismiss(best)
        best = people.best_merge(proposals, [tuple(p) for p in sitting.dismissed], [], ids, ids)
    return g.spark.createDataFrame([(best.keep, best.merge, best.similarity)] if best else [], "keep long, merge long, similarity double")


# the greedy matching by hand: the most similar pair, then the most similar of those that share nobody with it
ALIKE_PAIRS = CENT + f""", p AS (SELECT a.person_id AS keep, b.person_id AS merge, round(list_inner_product(a.centroid, b.centroid), 6) AS similarity, list_inner_product(a.centroid, b.centroid) AS s
      FROM c a JOIN persons x ON x.id = a.person_id AND x.name IS NOT NULL CROSS JOIN c b JOIN persons y ON y.id = b.person_id AND y.name IS NULL WHERE list_inner_product(a.centroid, b.centroid) >= {ALIKE}),
    one AS (SELECT * FROM p ORDER BY similarity DESC, keep, merge LIMIT 1)"""
register("best_merge_suggestion", lambda g: suggested(g, 0), ALIKE_PAIRS + " SELECT keep, merge, similarity FROM one", "faces persons")
register("dismiss_merge", lambda g: suggested(g, 1), ALIKE_PAIRS + " SELECT p.keep, p.merge, p.similarity FROM p, one WHERE p.keep <> one.keep AND p.merge <> one.merge ORDER BY p.similarity DESC, p.keep, p.merge LIMIT 1", "faces persons")

# ---- vectors, faces, images
# the bits of a float by arithmetic: sign, exponent, fraction; the lowest byte first
register(
    "blob_encode", lambda g: g.faces.select("id", F.hex(vc.encode_column()(F.slice("embedding", 1, 2))).alias("h")),
    """WITH x AS (SELECT id, unnest([1, 2]) AS i, CAST(unnest(embedding[1:2]) AS DOUBLE) AS x FROM faces),
       e AS (SELECT id, i, x, CASE WHEN x = 0 THEN -127 ELSE CAST(floor(log2(abs(x))) AS BIGINT) END AS e FROM x),
       b AS (SELECT id, i, CASE WHEN x < 0 THEN 2147483648 ELSE 0 END + (e + 127) * 8388608 + CASE WHEN x = 0 THEN 0 ELSE CAST(round((abs(x) / power(2.0, e) - 1) * 8388608) AS BIGINT) END AS b FROM e)
       SELECT id, string_agg(printf('%02X%02X%02X%02X', b % 256, b // 256 % 256, b // 65536 % 256, b // 16777216), '' ORDER BY i) AS h FROM b GROUP BY id""",
    "faces",
)
register("blob_decode", lambda g: g.faces.select("id", F.round(vc.decode_column()(vc.encode_column()("embedding"))[3].cast("double"), 6).alias("x")), "SELECT id, round(CAST(embedding[4] AS DOUBLE), 6) AS x FROM faces", "faces")
STRIDES = (8, 16, 32)


def levels(g):
    """Candidates of three detector levels: every face, seen by each at its own scale."""
    left, top, right, bottom = fc.boxes()
    return [g.faces.select("id", F.lit(s).alias("stride"), (F.col("confidence") / (k + 1)).alias("score"), F.round(left * s, 6).alias("x"), F.round(bottom * s, 6).alias("y")) for k, s in enumerate(STRIDES)]


register("stride_union", lambda g: fc.stride_union(levels(g)), "SELECT id, s AS stride, confidence / k AS score, round(box_left * s, 6) AS x, round(box_bottom * s, 6) AS y FROM faces, (VALUES (8, 1), (16, 2), (32, 3)) v(s, k)", "faces")
IOU = "(greatest(0, least(a.box_right, b.box_right) - greatest(a.box_left, b.box_left)) * greatest(0, least(a.box_bottom, b.box_bottom) - greatest(a.box_top, b.box_top)))"
AREAS = "((a.box_right - a.box_left) * (a.box_bottom - a.box_top) + (b.box_right - b.box_left) * (b.box_bottom - b.box_top))"


def overlaps(g):
    b = g.faces.select((F.col("id") + 1).alias("id"), *(F.col(f"box_{s}").alias(f"d_{s}") for s in ("left", "top", "right", "bottom")))
    return g.faces.join(b, "id").select("id", F.round(fc.iou_columns(fc.boxes(), fc.boxes("d_")), 6).alias("iou"))


register("iou", overlaps, f"SELECT a.id, round({IOU} / ({AREAS} - {IOU}), 6) AS iou FROM faces a JOIN faces b ON a.id = b.id + 1", "faces")
register("to_pixels", lambda g: g.faces.select("id", F.round(fc.to_pixels(F.array(*fc.boxes()), F.lit(640), F.lit(480))[1], 6).alias("y")), "SELECT id, round(box_top * 480, 6) AS y FROM faces", "faces")


def grays(g, f):
    @F.pandas_udf("double")
    def run(s):
        return s.map(lambda v: round(f(np.asarray(v, float)), 6))

    return g.faces.select("id", run("embedding").alias("x"))


register("grayscale_mean_std", lambda g: grays(g, lambda v: fc.grayscale_mean_std(v)[1]), "SELECT id, round(list_stddev_pop(CAST(embedding AS DOUBLE[])), 6) AS x FROM faces", "faces")

def moved(left: float, top: float) -> np.ndarray:
    """The template, scaled by 1 + left, turned by 90 degrees times top and shifted."""
    t, c, s = np.array(fc.TEMPLATE).reshape(-1, 2), np.cos(np.pi / 2 * top), np.sin(np.pi / 2 * top)
    return ((1 + left) * t @ np.array([[c, s], [-s, c]]) + [3, 5]).ravel()


def fit(i: int, left: float, top: float) -> tuple:
    t = fc.similarity_transform(np.array(fc.TEMPLATE), moved(left, top))
    return i, *(round(x, 3) + 0.0 for x in t), round(fc.similarity_scale(t), 3), round(fc.roll_degrees(t), 3)


fits = lambda g: map_rows(g.faces.select("id", "box_left", "box_top"), lambda: fit, "id long, a double, b double, tx double, ty double, scale double, roll double")
register("similarity_transform", lambda g: fits(g).select("id", "a", "b", "tx", "ty"), "SELECT id, round((1 + box_left) * cos(pi() / 2 * box_top), 3) AS a, round((1 + box_left) * sin(pi() / 2 * box_top), 3) AS b, CAST(3 AS DOUBLE) AS tx, CAST(5 AS DOUBLE) AS ty FROM faces", "faces")
register("similarity_scale", lambda g: fits(g).select("id", "scale"), "SELECT id, round(1 + box_left, 3) AS scale FROM faces", "faces")
register("roll_degrees", lambda g: fits(g).select("id", "roll"), "SELECT id, round(90 * box_top, 3) AS roll FROM faces", "faces")
#: The residual of the identity against points that are off by the box's left and top: sqrt(left ** 2 + top ** 2).
register("alignment_residual", lambda g: map_rows(g.faces.select("id", "box_left", "box_top"), lambda: lambda i, x, y: (i, round(fc.alignment_residual((1.0, 0.0, 0.0, 0.0), np.array(fc.TEMPLATE), np.array(fc.TEMPLATE) + np.tile([x, y], 5)), 6)), "id long, r double"), "SELECT id, round(sqrt(box_left ** 2 + box_top ** 2), 6) AS r FROM faces", "faces")
#: The four-neighbour sum at each inner place of the vector as an 8 x 8 picture.
register(
    "laplacian_variance", lambda g: grays(g, lambda v: fc.laplacian_variance(v, 8, 8)),
    """WITH v AS (SELECT id, CAST(embedding AS DOUBLE[]) AS v FROM faces),
       l AS (SELECT id, list_transform(list_filter(range(0, 64), lambda p: p % 8 BETWEEN 1 AND 6 AND p // 8 BETWEEN 1 AND 6), lambda p: v[p - 7] + v[p + 9] + v[p] + v[p + 2] - 4 * v[p + 1]) AS l FROM v)
       SELECT id, round(list_var_pop(l), 6) AS x FROM l""",
    "faces",
)


corners = lambda g, one, schema: map_rows(g.faces.select("id", *fc.boxes()), lambda: one, schema)
register(
    "face_crop_rect", lambda g: corners(g, lambda i, *b: (i, *fc.face_crop_rect(*b, 640, 480)), "id long, l int, t int, r int, b int"),
    """WITH s AS (SELECT *, CAST(trunc(least(greatest((box_right - box_left) * 640, (box_bottom - box_top) * 480) * 1.5, 480)) AS INT) AS side FROM faces),
       p AS (SELECT id, side, CAST(least(greatest(trunc((box_left + box_right) / 2 * 640 - side / 2), 0), 640 - side) AS INT) AS l, CAST(least(greatest(trunc((box_top + box_bottom) / 2 * 480 - side / 2), 0), 480 - side) AS INT) AS t FROM s)
       SELECT id, l, t, l + side AS r, t + side AS b FROM p""",
    "faces",
)
register("source_size_for", lambda g: g.faces.select("id", fc.source_size_for(*fc.boxes(), F.lit(160), F.lit(1024)).alias("size")), "WITH s AS (SELECT id, greatest(box_right - box_left, box_bottom - box_top) * CAST(1.5 AS DOUBLE) AS s FROM faces) SELECT id, CAST(CASE WHEN s <= 0 THEN 160 ELSE least(greatest(ceil(160 / s), 160), 1024) END AS INT) AS size FROM s", "faces")


def cell(i: int, score: float) -> tuple:
    """One cell of a level of 4 x 4 cells, 16 pixels each: which one, and how wide its box is, depend on the face."""
    cls, bbox, kps = np.zeros(16), np.zeros((16, 4)), np.zeros((16, 5, 2))
    k = i % 16
    cls[k], bbox[k] = score, (0.25, 0.5, np.log(1 + i % 3), 0.0)
    kps[k, 0] = (0.5, 0.25)
    return cls, bbox.ravel(), kps.ravel()


def strided(i: int, score: float) -> tuple:
    cls, bbox, kps = cell(i, score)
    got = fc.decode_stride(cls, np.ones(16), bbox, kps, 16, 4, 0.5)
    return (i, round(got[0]["score"], 6), *(round(x, 6) for x in got[0]["box"]), *(round(x, 6) for x in got[0]["landmarks"][:2])) if got else (i, *[None] * 7)


CELL = "c AS (SELECT id, sqrt(least(confidence, 1)) AS score, id % 16 % 4 AS x, id % 16 // 4 AS y, (1 + id % 3) * 8 AS half FROM faces)"
register(
    "decode_stride", lambda g: map_rows(g.faces.select("id", "confidence"), lambda: strided, "id long, score double, l double, t double, r double, b double, ex double, ey double"),
    f"""WITH {CELL} SELECT id, CASE WHEN score >= 0.5 THEN round(score, 6) END AS score, CASE WHEN score >= 0.5 THEN CAST((x + 0.25) * 16 - half AS DOUBLE) END AS l, CASE WHEN score >= 0.5 THEN CAST((y + 0.5) * 16 - 8 AS DOUBLE) END AS t,
        CASE WHEN score >= 0.5 THEN CAST((x + 0.25) * 16 + half AS DOUBLE) END AS r, CASE WHEN score >= 0.5 THEN CAST((y + 0.5) * 16 + 8 AS DOUBLE) END AS b, CASE WHEN score >= 0.5 THEN CAST((x + 0.5) * 16 AS DOUBLE) END AS ex, CASE WHEN score >= 0.5 THEN CAST((y + 0.25) * 16 AS DOUBLE) END AS ey FROM c""",
    "faces",
)


def located(i: int, score: float) -> tuple:
    """The same cell found in a picture of 64 x 48: shares of the picture, boxes clamped to it."""
    cls, bbox, kps = cell(i, score)
    got = inference.locate_faces(np.full((48, 64, 3), 128, np.uint8), 64, lambda _: [(cls, np.ones(16), bbox, kps, 16, 4)], score=0.5)
    return (i, *(round(x, 6) for x in got[0]["box"]), round(got[0]["landmarks"][1], 6)) if got else (i, *[None] * 5)


SHARE = "round(least(greatest({} / CAST({} AS DOUBLE), 0), 1), 6)"
register(
    "locate_faces", lambda g: map_rows(g.faces.select("id", "confidence"), lambda: located, "id long, l double, t double, r double, b double, ey double"),
    f"""WITH {CELL} SELECT id, CASE WHEN score >= 0.5 THEN {SHARE.format("((x + 0.25) * 16 - half)", 64)} END AS l, CASE WHEN score >= 0.5 THEN {SHARE.format("((y + 0.5) * 16 - 8)", 48)} END AS t,
        CASE WHEN score >= 0.5 THEN {SHARE.format("((x + 0.25) * 16 + half)", 64)} END AS r, CASE WHEN score >= 0.5 THEN {SHARE.format("((y + 0.5) * 16 + 8)", 48)} END AS b, CASE WHEN score >= 0.5 THEN round((y + 0.25) * 16 / CAST(48 AS DOUBLE), 6) END AS ey FROM c""",
    "faces",
)
PROMPTED = ModelConfig("clip", "m", {}, embedding_dim=2, image_size=4, tokenizer="unigram", prompt_template="a photo of {}")


def text_encoder():
    """Letters are tokens, padded to 40; the session answers with how many count and their sum, beside an output that must not be picked."""

    class Letters:
        def encode(self, text):
            ids = [ord(c) for c in text]
            return ids + [0] * (40 - len(ids)), [1] * len(ids) + [0] * (40 - len(ids))

    def session(x):
        n, s = x["attention_mask"].sum(), (x["input_ids"] * x["attention_mask"]).sum()
        return {"pooler_output": np.array([[9.0, 0.0]]), "text_embeds": np.array([[float(n), s / 100]])}

    return lambda text: inference.encode_text(text, PROMPTED, Letters(), session)


register(
    "encode_text", lambda g: inference.encode_column(g.photos, text_encoder, "id", "file_name").select("id", F.round(F.col("embedding")[0].cast("double"), 5).alias("x"), F.round(F.col("embedding")[1].cast("double"), 5).alias("y")),
    """WITH t AS (SELECT id, string_split('a photo of ' || file_name, '') AS t FROM photos), n AS (SELECT id, CAST(len(t) AS DOUBLE) AS n, list_sum(list_transform(t, lambda c: ascii(c))) / 100 AS s FROM t)
       SELECT id, round(n / sqrt(n * n + s * s), 5) AS x, round(s / sqrt(n * n + s * s), 5) AS y FROM n""",
)


def image_encoder():
    """Pictures of one colour each, by their path; the session answers with the mean of red and of green."""

    def session(x):
        return {"image_embeds": x["pixel_values"][:, :2].mean((2, 3)).astype(float) + [[2.0, 3.0]]}

    def encode(path):
        n = int(path.rsplit("/", 1)[1])
        return inference.encode_image(np.tile(np.array([n % 256, n * 7 % 256, 9], np.uint8), (6, 8, 1)), PROMPTED, session)

    return encode


register(
    "encode_image", lambda g: inference.encode_column(g.photos, image_encoder, "id", "file_path").select("id", F.round(F.col("embedding")[0].cast("double"), 5).alias("x"), F.round(F.col("embedding")[1].cast("double"), 5).alias("y")),
    """WITH c AS (SELECT id, (id % 256 / CAST(255 AS DOUBLE) - 0.5) / 0.5 + 2 AS r, (id * 7 % 256 / CAST(255 AS DOUBLE) - 0.5) / 0.5 + 3 AS v FROM photos)
       SELECT id, round(r / sqrt(r * r + v * v), 5) AS x, round(v / sqrt(r * r + v * v), 5) AS y FROM c""",
)


def shouting(k: int, name: str) -> tuple:
    """A model that spells a text in capitals, behind its language gate, and breaks on names that end in 3."""

    def step(state, ids):
        if name.endswith("3"):
            raise OSError("broken")
        out = np.zeros(200)
        out[int(state[len(ids) - 1]) if len(ids) <= len(state) else 1] = 1
        return out

    t = inference.Translator(PROMPTED, ["fr", "DE"], "en", lambda s: np.array([ord(c) for c in s.upper()]), step, lambda ids: "".join(map(chr, ids)))
    return k, t.translate(name.lower(), ("fr", "de", "es")[k % 3], ("EN",) if k % 2 else ())


register("translate", lambda g: map_rows(nations(g, "n_name"), lambda: shouting, "k long, text string"), f"SELECT {K}, CASE WHEN n_nationkey % 3 < 2 AND right(n_name, 1) <> '3' THEN upper(n_name) END AS text FROM nation")


def measured(i: int, left: float, top: float, right: float, bottom: float, score: float) -> tuple:
    """Measures of a crop that is half black and half of one grey, turned and scaled as the box says."""
    crop = np.zeros((8, 8, 3), np.uint8)
    crop[:, 4:] = i % 200 + 50
    face = {"score": score, "box": [left, top, right, bottom], "landmarks": [left, top, right, bottom, 0, 0, 0, 0, 0, 0]}
    m = inference.face_metrics(crop, (1 + left, top, 0.0, 0.0), face)
    return i, *(round(float(m[c]), 5) for c in ("detection", "scale", "roll", "blur", "mean", "std", "eye_distance", "edge_margin", "aspect"))


register(
    "face_metrics", lambda g: map_rows(g.faces.select("id", *fc.boxes(), "confidence"), lambda: measured, "id long, detection double, scale double, roll double, blur double, mean double, std double, eyes double, margin double, aspect double"),
    """WITH m AS (SELECT *, CAST(id % 200 + 50 AS DOUBLE) AS v FROM faces)
       SELECT id, round(confidence, 5) AS detection, round(sqrt((1 + box_left) ** 2 + box_top ** 2), 5) AS scale, round(degrees(atan2(box_top, 1 + box_left)), 5) AS roll, round(v * v / 3, 5) AS blur, round(v / 2, 5) AS mean, round(v / 2, 5) AS std,
         round(sqrt((box_right - box_left) ** 2 + (box_bottom - box_top) ** 2), 5) AS eyes, round(least(box_left, box_top, 1 - box_right, 1 - box_bottom), 5) AS margin, round((box_right - box_left) / (box_bottom - box_top), 5) AS aspect FROM m""",
    "faces",
)


def embedded(i: int) -> tuple:
    """The session answers with the mean of red and 2: the crop's tensor is its colour on a scale from -1 to 1."""
    v = inference.embed_face(np.full((4, 4, 3), i % 256, np.uint8), lambda x: {"out": np.array([[float(x["input"][:, 0].mean()), 2.0]])}, 2)
    return i, round(float(v[0]), 5), round(float(v[1]), 5)


register("embed_face", lambda g: map_rows(g.faces.select("id"), lambda: embedded, "id long, x double, y double"), "WITH c AS (SELECT id, (id % 256 / CAST(255 AS DOUBLE) - 0.5) / 0.5 AS c FROM faces) SELECT id, round(c / sqrt(c * c + 4), 5) AS x, round(2 / sqrt(c * c + 4), 5) AS y FROM c", "faces")


def canvas(i: int, width: int, height: int) -> tuple:
    """Where a white picture lies on the detector's black square."""
    got, w, h = inference.detection_canvas(np.full((height, width, 3), 255, np.uint8), 48)
    return i, w, h, int((got[:, :, 0] == 255).sum()), got.shape[0]


register(
    "detection_canvas", lambda g: map_rows(g.photos.filter("width is not null and height is not null").select("id", (F.col("width") % 90 + 10).cast("int"), (F.col("height") % 90 + 10).cast("int")), lambda: canvas, "id long, w long, h long, lit long, side long"),
    """WITH s AS (SELECT id, width % 90 + 10 AS w, height % 90 + 10 AS h FROM photos WHERE width IS NOT NULL AND height IS NOT NULL), f AS (SELECT id, CAST(greatest(1, round_even(w * (48 / greatest(w, h)), 0)) AS BIGINT) AS w, CAST(greatest(1, round_even(h * (48 / greatest(w, h)), 0)) AS BIGINT) AS h FROM s)
       SELECT id, w, h, w * h AS lit, CAST(48 AS BIGINT) AS side FROM f""",
)


def policies(g):
    """What choosing each model would do; a choice is one model's, so this asks once a model."""
    rows = [(r.id, activation(g.models, r.id)[0]) for r in g.models.select("id").collect()]
    return g.spark.createDataFrame(rows, "id long, policy string")


register("model_activation_policy", policies, "SELECT id, CASE WHEN is_active THEN 'none' WHEN model_type IN ('clip', 'face_detection', 'face_embedding') THEN 'confirm' ELSE 'activate' END AS policy FROM ai_models", "ai_models")
TOY = tk.Unigram([("<unk>", 0.0), ("▁IMG", -1.0), ("_", -1.0), *((c, -2.0) for c in "0123456789.jpg")])


def decoded(g):
    """Ids of the pieces, back to text: the unknown piece and those to skip leave no trace."""
    ids = F.concat(F.array(F.lit(1), F.lit(2)), F.transform(F.split(F.col("id").cast("string"), ""), lambda c: c.cast("int") + 3), F.array(F.lit(99), F.lit(2), F.lit(13)))

    @F.pandas_udf("string")
    def run(s):
        return s.map(lambda x: TOY.decode(x, skip=[13]))

    @F.pandas_udf("string")
    def back(s):
        return s.map(lambda t: TOY.decode(TOY.encode(t)))

    return g.photos.select("id", run(ids).alias("s"), back("file_name").alias("name"))


register("unigram_decode", decoded, "SELECT id, 'IMG_' || id || '_' AS s, file_name AS name FROM photos")

# ---- exports


def exported(g, write, name: str, columns: str):
    """What a CSV export reads back as."""
    path = f"{shared_dir(g.spark)}/{name}-{uuid.uuid4().hex}"
    write(path)
    return g.spark.read.csv(path, header=True, schema=columns)


PAIR = "same_person int, similarity double, face_a long, face_b long, person_a long, person_b long, name_a string, name_b string"
register(
    "export_face_pairs_csv", lambda g: exported(g, lambda path: exports.export_face_pairs(g.faces, g.persons, path), "pairs", PAIR).withColumn("similarity", F.round("similarity", 6)),
    """SELECT CASE WHEN a.person_id = b.person_id THEN 1 ELSE 0 END AS same_person, round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity, a.id AS face_a, b.id AS face_b,
       a.person_id AS person_a, b.person_id AS person_b, p.name AS name_a, q.name AS name_b FROM faces a JOIN faces b ON a.id < b.id JOIN persons p ON p.id = a.person_id JOIN persons q ON q.id = b.person_id""",
    "faces persons",
)
register("pairwise_faces", lambda g: people.id_pairs(g.faces), "SELECT a.id AS face_a, b.id AS face_b FROM faces a JOIN faces b ON a.id < b.id", "faces")


def detections(g):
    """What a detector finds again: each stored box a little off, with measures made of its numbers."""
    boxes = ((F.col(f"box_{s}") + F.lit(0.01)).alias(f"box_{s}") for s in ("left", "top", "right", "bottom"))
    n = lambda k: (F.col("id") * k % 100).cast("double")
    measures = {"score": F.col("confidence"), "cls": n(3) / 100, "obj": n(7) / 100, "rmse": n(11) / 10, "scale": 0.5 + n(13) / 100, "roll": n(17), "blur": 10 + n(19) * 5, "photo_blur": n(23), "brightness": n(29), "contrast": n(31)}
    return g.faces.select("photo_id", (F.col("id") + 5000).alias("det_id"), marks().alias("landmarks"), *(c.alias(k) for k, c in measures.items()), *boxes)


NUMBERS = "quality det_score det_cls det_obj box_w box_h box_aspect face_px eye_dist_px"
MORE = "edge_margin align_rmse align_scale align_roll_deg yaw pitch blur photo_blur brightness contrast"
METRIC = ", ".join(["face_id long, person_id long, name string", *(f"{c} double" for c in NUMBERS.split()), "photo_px long", *(f"{c} double" for c in MORE.split())])


def metrics(g):
    got = exported(g, lambda path: exports.export_face_metrics(g.faces, detections(g), g.persons, g.photos, path), "metrics", METRIC)
    return got.select(*(F.round(c, 5).alias(c) if kind == "double" else F.coalesce(c, F.lit("")).alias(c) if kind == "string" else F.col(c) for c, kind in got.dtypes))


register(
    "export_face_metrics_csv", metrics,
    f"""WITH d AS (SELECT *, box_left + 0.01 AS l, box_top + 0.01 AS t, box_right + 0.01 AS r, box_bottom + 0.01 AS b, coalesce(weight, 0) AS w0 FROM faces),
        j AS (SELECT s.id AS face_id, s.person_id, d.*, row_number() OVER (PARTITION BY s.id ORDER BY {IOU.replace("b.box_left", "d.l").replace("b.box_top", "d.t").replace("b.box_right", "d.r").replace("b.box_bottom", "d.b").replace("a.", "s.")} / ({AREAS.replace("b.box_left", "d.l").replace("b.box_top", "d.t").replace("b.box_right", "d.r").replace("b.box_bottom", "d.b").replace("a.", "s.")}) DESC, d.id) AS k,
              {IOU.replace("b.box_left", "d.l").replace("b.box_top", "d.t").replace("b.box_right", "d.r").replace("b.box_bottom", "d.b").replace("a.", "s.")} AS i, {AREAS.replace("b.box_left", "d.l").replace("b.box_top", "d.t").replace("b.box_right", "d.r").replace("b.box_bottom", "d.b").replace("a.", "s.")} AS u
              FROM faces s JOIN d ON d.photo_id = s.photo_id),
        m AS (SELECT j.*, 0.5 + j.id * 13 % 100 / 100 AS scale, CAST(10 + j.id * 19 % 100 * 5 AS DOUBLE) AS blur, coalesce(p.width, 0) AS pw, coalesce(p.height, 0) AS ph FROM j JOIN photos p ON p.id = j.photo_id WHERE k = 1 AND i / (u - i) >= 0.5)
        SELECT face_id, person_id, coalesce((SELECT name FROM persons x WHERE x.id = person_id), '') AS name,
          round(least(greatest(confidence, 0), 1) * least(1 / greatest(scale, 0.001), 2) / 2 * least(greatest((log10(greatest(blur, 0.01)) - 0.5) / 2, 0), 1), 5) AS quality,
          round(confidence, 5) AS det_score, round(id * 3 % 100 / 100, 5) AS det_cls, round(id * 7 % 100 / 100, 5) AS det_obj, round(r - l, 5) AS box_w, round(b - t, 5) AS box_h, round((r - l) / (b - t), 5) AS box_aspect,
          round((r - l) * pw, 5) AS face_px, round({E} * pw, 5) AS eye_dist_px, CAST(pw AS BIGINT) * ph AS photo_px, round(least(l, t, 1 - r, 1 - b), 5) AS edge_margin, round(id * 11 % 100 / 10, 5) AS align_rmse, round(scale, 5) AS align_scale,
          CAST(id * 17 % 100 AS DOUBLE) AS align_roll_deg, round((({NX} - ({X0} + {X1}) / 2) * ({X1} - {X0}) + ({NY} - ({Y0} + {Y1}) / 2) * ({Y1} - {Y0})) / ({E} * {E}), 5) AS yaw, round({PITCH} - {fc.TEMPLATE_PITCH!r}, 5) AS pitch,
          blur, CAST(id * 23 % 100 AS DOUBLE) AS photo_blur, CAST(id * 29 % 100 AS DOUBLE) AS brightness, CAST(id * 31 % 100 AS DOUBLE) AS contrast FROM m""",
    "faces persons photos",
)
