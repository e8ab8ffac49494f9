"""Vector and face-geometry queries."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import faces as fc
from ..functions import vectors as vc
from ..operators import people as pe
from ..operators import photos as ph
from . import register
from .photos import BOX, IN_BOX


@cache
def _query(path: str, spark) -> tuple[float, ...]:
    return tuple(spark.read.parquet(f"{path}/embeddings.parquet").filter("vec_id = 5").select("embedding").first().embedding)


def query_of(g) -> tuple[float, ...]:
    """The fixture's query vector."""
    return _query(g.dir, g.spark)


SIM = "list_inner_product(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 5))"
register("dot_product", lambda g: vc.scored(g.analyses, query_of(g)).select("id", F.round("score", 6).alias("score")), f"SELECT photo_id AS id, round({SIM}, 6) AS score FROM photo_analyses WHERE embedding IS NOT NULL", "photo_analyses")
register("query_x_embeddings", lambda g: vc.scored(g.analyses, query_of(g), native=False).select("id", F.round("score", 6).alias("score")), f"SELECT photo_id AS id, round({SIM}, 6) AS score FROM photo_analyses WHERE embedding IS NOT NULL", "photo_analyses")


def semantic(g, floor: float = 0.2, k: int = 200, box=None) -> DataFrame:
    rows = vc.scored(ph.embeddings_of(g.analyses, "clip_embedding", "m1"), query_of(g))
    rows = rows.withColumn("score", F.round("score", 6)).filter(F.col("score") >= floor)
    shown = ph.hard_filter(g.photos, g.faces, ph.Criteria(box=box)).select("id")
    return vc.top_k(rows.join(shown, "id", "left_semi"), k)


SEM = f"""WITH s AS (SELECT photo_id AS id, round({SIM}, 6) AS score FROM photo_analyses WHERE analysis_type = 'clip_embedding' AND model_name = 'm1' AND embedding IS NOT NULL)
    SELECT id, score FROM s WHERE score >= {{floor}} AND id IN (SELECT id FROM photos WHERE NOT is_hidden{{also}}) ORDER BY score DESC, id LIMIT {{k}}"""
register("semantic_search", semantic, SEM.format(floor=0.2, k=200, also=""), "photo_analyses photos")
register("semantic_search_filtered", lambda g: semantic(g, box=BOX, floor=-1.0, k=50), SEM.format(floor=-1.0, k=50, also=f" AND {IN_BOX}"), "photo_analyses photos")
register("topk_similarity", lambda g: semantic(g, floor=-1.0), SEM.format(floor=-1.0, k=200, also=""), "photo_analyses photos")
register("embeddings_for_photos", lambda g: ph.with_ids(ph.embeddings_of(g.analyses, "clip_embedding", "m1"), [1, 2, 4, 3], "photo_id").select("photo_id", "embedding_dim"), "SELECT photo_id, embedding_dim FROM photo_analyses WHERE embedding IS NOT NULL AND photo_id IN (1, 2, 3, 4)", "photo_analyses")
register("embeddings_chunk", lambda g: ph.embeddings_chunk(g.analyses, "clip_embedding", "m1", 20, 100).select("photo_id", "embedding_dim"), "SELECT photo_id, embedding_dim FROM photo_analyses WHERE embedding IS NOT NULL AND photo_id > 20 ORDER BY photo_id LIMIT 100", "photo_analyses")
each = lambda rows, c: rows.select("id", F.posexplode(c).alias("i", "x")).select("id", F.col("i").cast("long").alias("i"), F.round(F.col("x").cast("double"), 5).alias("x"))
register(
    "normalize_l2",
    lambda g: each(g.faces.select("id", vc.normalize_l2(F.transform("embedding", lambda x: x * F.lit(3.0).cast("float"))).alias("v")), "v"),
    """WITH v AS (SELECT id, list_transform(embedding, lambda x: CAST(x * CAST(3 AS FLOAT) AS FLOAT)) AS v FROM faces),
       n AS (SELECT id, v, sqrt(list_sum(list_transform(v, lambda x: CAST(x AS DOUBLE) * x))) AS n FROM v)
       SELECT id, CAST(generate_subscripts(v, 1) - 1 AS BIGINT) AS i, round(CAST(CAST(unnest(v) / n AS FLOAT) AS DOUBLE), 5) AS x FROM n""",
    "faces",
)
register("blob_round_trip", lambda g: each(g.faces.select("id", vc.decode_column()(vc.encode_column()("embedding")).alias("v")), "v"), "SELECT id, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS i, round(CAST(unnest(embedding) AS DOUBLE), 5) AS x FROM faces", "faces")

CENT = """WITH u AS (SELECT person_id, weight, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM faces WHERE assignment_type IN ('auto', 'manual')),
    s AS (SELECT person_id, i, sum(weight * CAST(x AS DOUBLE)) AS s FROM u GROUP BY person_id, i),
    c AS (SELECT person_id, list(s / n ORDER BY i) AS centroid FROM (SELECT *, sqrt(sum(s * s) OVER (PARTITION BY person_id)) AS n FROM s) x GROUP BY person_id)"""


def components(df: DataFrame) -> DataFrame:
    return df.select("person_id", F.posexplode("centroid").alias("i", "x")).select("person_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


register("weighted_centroid", lambda g: components(pe.centroids(g.faces)), CENT + " SELECT person_id, CAST(i - 1 AS BIGINT) AS i, round(x, 6) AS x FROM (SELECT person_id, unnest(centroid) AS x, generate_subscripts(centroid, 1) AS i FROM c) y", "faces")


def with_centroids(g) -> DataFrame:
    return g.persons.withColumn("centroid_embedding", F.lit(None).cast("array<double>")).withColumn("centroid_updated_at", F.lit(None).cast("long"))


register(
    "recompute_centroid",
    lambda g: pe.recompute_centroids(with_centroids(g), g.faces, 5).select("id", "centroid_updated_at", F.posexplode_outer("centroid_embedding").alias("i", "x")).select("id", "centroid_updated_at", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x")),
    CENT + """, e AS (SELECT person_id, CAST(generate_subscripts(centroid, 1) - 1 AS BIGINT) AS i, round(unnest(centroid), 6) AS x FROM c)
       SELECT p.id, CASE WHEN e.i IS NOT NULL THEN CAST(5 AS BIGINT) END AS centroid_updated_at, e.i, e.x FROM persons p LEFT JOIN e ON e.person_id = p.id""",
    "faces persons",
)
register(
    "elect_primary_face",
    lambda g: pe.elect_primary_faces(g.faces).select("id", "is_primary"),
    CENT + """, n AS (SELECT f.id, row_number() OVER (PARTITION BY f.person_id ORDER BY round(list_inner_product(CAST(f.embedding AS DOUBLE[]), c.centroid), 9) DESC, f.id) AS k
       FROM faces f JOIN c ON c.person_id = f.person_id WHERE f.assignment_type IN ('auto', 'manual'))
       SELECT f.id, CASE WHEN f.assignment_type IN ('auto', 'manual') THEN n.k = 1 ELSE f.is_primary END AS is_primary FROM faces f LEFT JOIN n ON n.id = f.id""",
    "faces",
)


def frozen(g) -> DataFrame:
    people = g.persons.select(F.col("id").alias("person_id"), F.col("name").isNotNull().alias("named"))
    return pe.centroids(g.faces).join(people, "person_id")


PAIRS = CENT + """, q AS (SELECT f.id, c.person_id, p.name IS NOT NULL AS named, round(list_inner_product(CAST(f.embedding AS DOUBLE[]), c.centroid), 6) AS s FROM faces f CROSS JOIN c JOIN persons p ON p.id = c.person_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, person_id) AS k FROM q)"""
register(
    "assign_face",
    lambda g: pe.assign_faces(g.faces, frozen(g), round_to=6).select("id", "person_id", "similarity", "outcome"),
    PAIRS + " SELECT id, CASE WHEN s >= 0.45 OR (s >= 0.40 AND named) THEN person_id END AS person_id, s AS similarity, CASE WHEN s >= 0.45 THEN 'auto' WHEN s >= 0.40 AND named THEN 'pending' ELSE 'new' END AS outcome FROM r WHERE k = 1",
    "faces persons",
)
register("calibration_best_similarity", lambda g: pe.assign_faces(g.faces, frozen(g), round_to=6).select("id", "similarity"), PAIRS + " SELECT id, s AS similarity FROM r WHERE k = 1", "faces persons")
register(
    "pairwise_centroids",
    lambda g: pe.merge_candidates(frozen(g), -1.0).select("keep", "merge", F.round("similarity", 6).alias("similarity")),
    CENT + " SELECT a.person_id AS keep, b.person_id AS merge, round(list_inner_product(a.centroid, b.centroid), 6) AS similarity FROM c a JOIN persons p ON p.id = a.person_id AND p.name IS NOT NULL CROSS JOIN c b JOIN persons q ON q.id = b.person_id AND q.name IS NULL",
    "faces persons",
)


#: Floor of the proposals over the fixture's vectors; what reaches it comes to the driver, to be matched there.
ALIKE = 0.0


def proposals(g) -> DataFrame:
    pairs = pe.merge_candidates(frozen(g), ALIKE).collect()
    rows = [(m.keep, m.merge, round(m.similarity, 6)) for m in pe.propose_merges((r.keep, r.merge, r.similarity) for r in pairs)]
    return g.spark.createDataFrame(rows, "keep long, merge long, similarity double")


# one proposal a step: the most similar pair of people that no earlier proposal has used
register(
    "propose_merges", proposals,
    "WITH RECURSIVE" + CENT[4:] + f""", p AS (SELECT a.person_id AS keep, b.person_id AS merge, list_inner_product(a.centroid, b.centroid) AS s
        FROM c a JOIN persons x ON x.id = a.person_id AND x.name IS NOT NULL CROSS JOIN c b JOIN persons y ON y.id = b.person_id AND y.name IS NULL WHERE list_inner_product(a.centroid, b.centroid) >= {ALIKE}),
      k AS (SELECT *, row_number() OVER (ORDER BY s DESC, keep, merge) AS k FROM p),
      r AS (SELECT CAST(0 AS BIGINT) AS at, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS keep, CAST(NULL AS BIGINT) AS merge, CAST(NULL AS DOUBLE) AS s
        UNION ALL SELECT k.k, list_concat(r.used, [k.keep, k.merge]), k.keep, k.merge, k.s FROM r, k
        WHERE k.k = (SELECT min(x.k) FROM k x WHERE x.k > r.at AND NOT list_contains(r.used, x.keep) AND NOT list_contains(r.used, x.merge)))
      SELECT keep, merge, round(s, 6) AS similarity FROM r WHERE keep IS NOT NULL""",
    "faces persons",
)
register(
    "topk_person_suggestions",
    lambda g: pe.suggestions(pe.recompute_centroids(with_centroids(g), g.faces, 5), list(query_of(g))).select("id", "name", F.round("similarity", 6).alias("similarity")),
    CENT + f" SELECT p.id, p.name, round(list_inner_product(c.centroid, (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 5)), 6) AS similarity FROM persons p JOIN c ON c.person_id = p.id WHERE p.name IS NOT NULL AND NOT p.is_hidden ORDER BY similarity DESC, p.id LIMIT 3",
    "faces persons",
)
register(
    "face_pairs",
    lambda g: pe.face_pairs(g.faces).select("face_a", "face_b", "same_person", F.round("similarity", 6).alias("similarity")),
    "SELECT a.id AS face_a, b.id AS face_b, a.person_id = b.person_id AS same_person, round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity FROM faces a JOIN faces b ON a.id < b.id",
    "faces",
)

# ---- face geometry on the fixture's boxes and on landmarks made of them


def marks():
    """Landmarks made of the box columns."""
    left, top, right, bottom = fc.boxes()
    return F.array(left, top, right, top + F.lit(0.02), (left + right) / 2 + F.lit(0.01), (top + bottom) / 2, left, bottom, right, bottom)


X0, Y0, X1, Y1, NX, NY = "box_left", "box_top", "box_right", "(box_top + 0.02)", "((box_left + box_right) / 2 + 0.01)", "((box_top + box_bottom) / 2)"
E = f"sqrt(({X1} - {X0}) ** 2 + ({Y1} - {Y0}) ** 2)"
r6 = lambda c: F.round(c, 6)
register("eye_distance", lambda g: g.faces.select("id", r6(fc.eye_distance(marks())).alias("d")), f"SELECT id, round({E}, 6) AS d FROM faces", "faces")
register("yaw_proxy", lambda g: g.faces.select("id", r6(fc.yaw_proxy(marks())).alias("yaw")), f"SELECT id, round((({NX} - ({X0} + {X1}) / 2) * ({X1} - {X0}) + ({NY} - ({Y0} + {Y1}) / 2) * ({Y1} - {Y0})) / ({E} * {E}), 6) AS yaw FROM faces", "faces")
PITCH = f"((({NX} - ({X0} + {X1}) / 2) * -({Y1} - {Y0}) + ({NY} - ({Y0} + {Y1}) / 2) * ({X1} - {X0})) / ({E} * {E}))"
register("pitch_proxy", lambda g: g.faces.select("id", r6(fc.pitch_proxy(marks())).alias("pitch")), f"SELECT id, round({PITCH} - {fc.TEMPLATE_PITCH!r}, 6) AS pitch FROM faces", "faces")
register("edge_margin", lambda g: g.faces.select("id", r6(fc.edge_margin(*fc.boxes())).alias("m")), "SELECT id, round(least(box_left, box_top, 1 - box_right, 1 - box_bottom), 6) AS m FROM faces", "faces")
register("box_aspect", lambda g: g.faces.select("id", r6(fc.box_aspect(*fc.boxes())).alias("a")), "SELECT id, round(CASE WHEN box_bottom - box_top <= 0 THEN 0 ELSE (box_right - box_left) / (box_bottom - box_top) END, 6) AS a FROM faces", "faces")
register("face_quality", lambda g: g.faces.select("id", r6(fc.face_quality(F.col("confidence"), F.col("weight"), F.col("id").cast("double") * 3)).alias("q")), "SELECT id, round(least(greatest(confidence, 0), 1) * least(1 / greatest(weight, 0.001), 2) / 2 * least(greatest((log10(greatest(CAST(id AS DOUBLE) * 3, 0.01)) - 0.5) / 2, 0), 1), 6) AS q FROM faces", "faces")
register("filter_min_size", lambda g: fc.filter_min_size(g.faces, 0.2).select("id"), "SELECT id FROM faces WHERE box_right - box_left >= 0.2 AND box_bottom - box_top >= 0.2", "faces")
IOU = "(greatest(0, least(a.box_right, b.box_right) - greatest(a.box_left, b.box_left)) * greatest(0, least(a.box_bottom, b.box_bottom) - greatest(a.box_top, b.box_top)))"
AREAS = "((a.box_right - a.box_left) * (a.box_bottom - a.box_top) + (b.box_right - b.box_left) * (b.box_bottom - b.box_top))"


def detected():
    """The boxes as pixels of a 640 x 480 image, some beyond its edges, normalised."""
    left, top, right, bottom = (c * 1000 for c in fc.boxes())
    return fc.normalized_box(left - 50, top - 20, right, bottom, F.lit(640.0), F.lit(480.0))


def shifted(g) -> DataFrame:
    """The stored boxes, moved a little, as if a detector had found them again."""
    return g.faces.select("photo_id", (F.col("id") + 1000).alias("det_id"), *((F.col(f"box_{s}") + F.lit(0.03)).alias(f"box_{s}") for s in ("left", "top", "right", "bottom")))


register(
    "match_box_iou",
    lambda g: fc.match_boxes(g.faces, shifted(g)).select("id", "det_id", r6(F.col("iou")).alias("iou")),
    f"""WITH d AS (SELECT photo_id, id + 1000 AS det_id, box_left + 0.03 AS box_left, box_top + 0.03 AS box_top, box_right + 0.03 AS box_right, box_bottom + 0.03 AS box_bottom FROM faces),
        p AS (SELECT a.id, b.det_id, {IOU} / ({AREAS} - {IOU}) AS iou FROM faces a JOIN d b ON a.photo_id = b.photo_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY iou DESC, det_id) AS k FROM p)
        SELECT id, det_id, round(iou, 6) AS iou FROM r WHERE k = 1 AND iou >= 0.5""",
    "faces",
)
#: Faces of 20 pictures each, so that there is something to suppress; in order of score each stays unless one that stayed overlaps it.
register(
    "nms", lambda g: fc.nms_per_photo(g.faces.withColumn("score", F.col("confidence")).withColumn("photo_id", F.floor(F.col("id") / 20)), 0.3).select("photo_id", "id"),
    f"""WITH RECURSIVE f AS (SELECT *, row_number() OVER (PARTITION BY photo ORDER BY confidence DESC, id) AS k FROM (SELECT *, id // 20 AS photo FROM faces) x),
        o AS (SELECT a.photo, a.k, list(b.k) AS hits FROM f a JOIN f b ON a.photo = b.photo AND b.k < a.k WHERE {IOU} / ({AREAS} - {IOU}) > 0.3 GROUP BY a.photo, a.k),
        r AS (SELECT photo, CAST(1 AS BIGINT) AS k, [CAST(1 AS BIGINT)] AS kept FROM f WHERE k = 1
              UNION ALL SELECT f.photo, f.k, CASE WHEN len(list_intersect(r.kept, coalesce(o.hits, CAST([] AS BIGINT[])))) = 0 THEN list_append(r.kept, f.k) ELSE r.kept END
              FROM r JOIN f ON f.photo = r.photo AND f.k = r.k + 1 LEFT JOIN o ON o.photo = f.photo AND o.k = f.k),
        e AS (SELECT photo, max_by(kept, k) AS kept FROM r GROUP BY photo)
        SELECT f.photo AS photo_id, f.id FROM f JOIN e ON e.photo = f.photo WHERE list_contains(e.kept, f.k)""",
    "faces",
)
register("to_detected_faces", lambda g: g.faces.select("id", *(r6(c).alias(n) for c, n in zip(detected(), ("l", "t", "r", "b"), strict=True))), "SELECT id, round(least(greatest((box_left * 1000 - 50) / 640, 0), 1), 6) AS l, round(least(greatest((box_top * 1000 - 20) / 480, 0), 1), 6) AS t, round(least(greatest(box_right * 1000 / 640, 0), 1), 6) AS r, round(least(greatest(box_bottom * 1000 / 480, 0), 1), 6) AS b FROM faces", "faces")
register("embed_source_size", lambda g: g.faces.select("id", fc.embed_source_size(F.col("box_right") - F.col("box_left"), F.lit(1024), F.lit(768), F.lit(112), F.lit(3072)).alias("size")), "WITH p AS (SELECT id, (box_right - box_left) * 768 AS px FROM faces) SELECT id, CAST(CASE WHEN px <= 0 OR 112 / px <= 1 THEN 1024 ELSE least(greatest(trunc(1024 * (112 / px)), 1024), 3072) END AS INT) AS size FROM p", "faces")


def search_query(g) -> DataFrame:
    """A whole search: a person, a month and a word that only names of files have."""
    from datetime import date

    from ..plans import search

    lib = search.Library(g.photos, g.faces, g.analyses, g.persons, g.cities, g.aliases)
    return search.search(lib, "IMG january 2024 without person 4", date(2026, 7, 6)).photos


def semantic_query(g) -> DataFrame:
    from datetime import date

    from ..plans import search

    lib = search.Library(g.photos, g.faces, g.analyses, g.persons, g.cities, g.aliases)
    found = search.search(lib, "sunset january 2024", date(2026, 7, 6), encode=lambda _: query_of(g), floor=-1.0)
    return found.photos.select("id", F.round("score", 6).alias("score"))


JANUARY = "date_taken BETWEEN 1704067200000 AND 1706745599999"
register("hybrid_search", search_query, f"SELECT id, file_path, file_name, date_added, date_taken, is_favorite FROM photos WHERE NOT is_hidden AND {JANUARY} AND lower(file_name) LIKE '%img%' AND NOT EXISTS (SELECT 1 FROM faces f WHERE f.photo_id = photos.id AND f.person_id = 4 AND f.assignment_type IN ('auto', 'manual'))", "photos faces")
register("hybrid_search_semantic", semantic_query, f"SELECT photo_id AS id, round({SIM}, 6) AS score FROM photo_analyses WHERE embedding IS NOT NULL AND photo_id IN (SELECT id FROM photos WHERE NOT is_hidden AND {JANUARY}) ORDER BY score DESC, id LIMIT 200", "photo_analyses photos")


def new_faces(g) -> DataFrame:
    from ..plans.faces import State, assign_new_faces

    rows = g.faces.select("id", "photo_id", "embedding", F.col("confidence").alias("quality"), "weight")
    return assign_new_faces(rows, State())


register("assign_new_faces", new_faces)
