"""Hand-made cases: geometry, tokenizers, vectors, assignment, merges, sync, models, search."""

import json
from datetime import date

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prismalake.functions import faces as fc
from prismalake.functions import geo, tokenizers, vectors
from prismalake.functions.text import escape_like, normalize_text
from prismalake.operators import mutate, people
from prismalake.operators import photos as ph
from prismalake.plans import search
from prismalake.plans.faces import State, assign_photo
from prismalake.plans.gallery import Gallery
from prismalake.sources import geonames, models
from prismalake.streaming import sync


def test_negated_filters_on_unknown_values(spark):
    rows = spark.createDataFrame([(1, None, None, None), (2, 5, 1.0, "x, FR"), (3, 50, 70.0, "y, DE")], "id long, date_taken long, latitude double, location_name string")
    rows = rows.withColumn("longitude", F.col("latitude")).withColumn("is_hidden", F.lit(False)).withColumn("media_type", F.lit(1))
    ids = lambda **c: sorted(r.id for r in ph.hard_filter(rows, rows, ph.Criteria(**c)).collect())
    assert ids(start_ms=0, end_ms=10, date_negated=True) == [3]
    assert ids(box=(0, 2, 0, 2), geo_negated=True) == [1, 3]
    assert ids(country="fr", country_negated=True) == [1, 3]


def test_folder_prefix_doesnt_leak(spark):
    from prismalake.sources.media import scan_incremental

    rows = spark.createDataFrame([(1, "DCIM/Camera/", 5), (2, "DCIM/CameraBackup/", 5), (3, None, 5)], "id long, relative_path string, modified_s long")
    assert [r.id for r in scan_incremental(rows, ["DCIM/Camera"]).collect()] == [1]
    assert scan_incremental(rows).count() == 3


def test_escape_and_normalize():
    assert escape_like("50%_a\\b") == "50\\%\\_a\\\\b"
    assert normalize_text("Œuvre d'Été ÆÇ") == "oeuvre d'ete aec"


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.floats(0, 1), st.floats(0.01, 1), st.floats(0.01, 1), st.floats(0, 1)), max_size=12), st.floats(0, 1))
def test_nms_is_idempotent(rows, threshold):
    b = np.array([[x, y, x + w, y + h] for x, y, w, h, _ in rows]).reshape(-1, 4)
    s = np.array([r[4] for r in rows])
    kept = fc.nms(b, s, threshold)
    assert fc.nms(b[kept], s[kept], threshold) == list(range(len(kept)))


def test_decode_one_cell():
    cls = obj = np.array([0, 0, 0.64, 0.0])
    got = fc.decode_stride(cls, obj, np.zeros(16), np.zeros(40), 8, 2, 0.5)
    assert len(got) == 1 and got[0]["score"] == pytest.approx(0.64)
    assert got[0]["box"] == [-4.0, 4.0, 4.0, 12.0]


def test_similarity_transform():
    pts = np.array(fc.TEMPLATE)
    assert fc.similarity_transform(pts, pts) == pytest.approx((1, 0, 0, 0), abs=1e-4)
    turned = np.stack([-pts[1::2], pts[0::2]], 1).ravel() * 2
    t = fc.similarity_transform(pts, turned)
    assert fc.similarity_scale(t) == pytest.approx(2, abs=1e-4) and fc.roll_degrees(t) == pytest.approx(90, abs=1e-3)
    assert fc.alignment_residual(t, pts, turned) == pytest.approx(0, abs=1e-3)
    with pytest.raises(ValueError, match="coincide"):
        fc.similarity_transform(np.ones(10), pts)


def test_quality(spark):
    q = spark.range(1).select(fc.face_quality(F.lit(0.88), F.lit(0.66), F.lit(410.0)).alias("q")).first().q
    assert q == pytest.approx(0.667, abs=2e-3)


def test_pixels():
    assert fc.laplacian_variance(np.ones(25), 5, 5) == 0 and fc.laplacian_variance(np.ones(4), 2, 2) == 0
    board = np.indices((6, 6)).sum(0) % 2
    assert fc.laplacian_variance(board, 6, 6) > 1
    assert fc.grayscale_mean_std(np.array([0, 2])) == (1.0, 1.0)


def test_clip_bpe():
    alphabet = tokenizers.byte_alphabet()
    vocab = {t: k for k, t in enumerate(["<|startoftext|>", "<|endoftext|>", "cat</w>", *alphabet.values(), *(c + "</w>" for c in alphabet.values())])}
    t = tokenizers.ClipBpe(vocab, tokenizers.parse_merges(["#version", "c a", "ca t</w>"]), 6)
    ids, mask = t.encode("  CAT ")
    assert ids[:3] == [0, 2, 1] and mask == [1, 1, 1, 0, 0, 0]
    ids, mask = t.encode("cat cat cat cat cat cat")
    assert ids == [0, 2, 2, 2, 2, 1] and sum(mask) == 6


def test_sentencepiece_bpe_bytes():
    t = tokenizers.SentencePieceBpe({"<pad>": 0, "<eos>": 1, "▁cat": 2, "<0xC3>": 3, "<0xA9>": 4, "▁": 5, "c": 6, "a": 7, "t": 8}, tokenizers.parse_merges([["▁", "c"], ["▁c", "a"], ["▁ca", "t"]]), 6)
    assert t.encode(" caté")[0] == [2, 3, 4, 1, 0, 0]
    assert t.encode(" cat")[1] == [1] * 6


def test_unigram_is_optimal():
    t = tokenizers.Unigram([("<unk>", 0.0), ("▁ab", -1.0), ("c", -9.0), ("▁a", -1.0), ("bc", -1.0)])
    assert t.encode("abc") == [3, 4]
    assert t.decode([3, 4]) == "abc"
    assert t.encode("z")[-1] == 0


def test_vectors(spark):
    assert vectors.encode_blob([1.0]) == b"\x00\x00\x80?"
    assert vectors.decode_blob(vectors.encode_blob([3.0, -4.0])) == [3.0, -4.0]
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, None)], "id long, embedding array<float>")
    got = {r.id: r.v for r in rows.select("id", vectors.normalize_l2(F.col("embedding")).alias("v")).collect()}
    assert got[1] == pytest.approx([0.6, 0.8]) and got[2] == [0, 0]
    scores = vectors.scored(rows, [1.0, 0.0], "id")
    assert {r.id for r in scores.collect()} == {1, 2}
    assert vectors.top_k(scores, 0).count() == 0
    assert sorted(map(tuple, scores.collect())) == sorted(map(tuple, vectors.scored(rows, [1.0, 0.0], "id", native=False).collect()))


def test_centroid_errors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], 1.0), (1, [1.0], 1.0)], "p long, v array<float>, w double")
    with pytest.raises(Exception, match="several dimensions"):
        vectors.weighted_centroid(rows, "p", "v", "w").collect()


def test_sequential_assignment():
    s = State(sums={1: np.array([1.0, 0.0]), 2: np.array([0.0, 1.0])}, named={2})
    face = lambda x, y, q=1.0: {"embedding": [x, y], "quality": q, "weight": 1.0}
    got, nxt = assign_photo(s, [face(1, 0), face(1, 0), face(0.1, 0.42), face(0, 1, 0.1)], next_id=10)
    assert [g["assignment_type"] for g in got] == ["auto", "auto", "pending", "ignored"]
    assert got[0]["person_id"] == 1 and got[1]["person_id"] == 10 and got[2]["person_id"] == 2 and nxt == 11
    assert assign_photo(s, [face(1, 0)], manual=True)[0][0] == {"assignment_type": "pending", "exclusion_reason": None, "person_id": None, "similarity": None}


def test_merges():
    got = people.propose_merges([(1, 5, 0.5), (1, 6, 0.9), (2, 5, 0.4), (2, 6, 0.8)])
    assert [(m.keep, m.merge) for m in got] == [(1, 6), (2, 5)]
    best = people.best_merge(got, [(6, 1)], [], [1, 2, 5, 6], [1, 2])
    assert (best.keep, best.merge) == (2, 5)


def test_upsert_algebra(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    n = spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")
    once = mutate.upsert(t, n, ["id"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, mutate.upsert(once, n, ["id"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    with pytest.raises(Exception, match="key exists"):
        mutate.insert_abort(t, n, ["id"]).collect()


def test_keys_repeated_in_a_batch(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    n = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 2), (3, "f", 1), (None, "x", 1), (None, "y", 1)], "id long, v string, seq int")
    rows = lambda df: sorted(map(str, map(tuple, df.collect())))
    assert rows(mutate.upsert(t, n, ["id"], ["seq"])) == rows(spark.createDataFrame([(1, "a"), (2, "d"), (3, "e"), (None, "x"), (None, "y")], "id long, v string"))
    assert rows(mutate.insert_ignore(t, n, ["id"], ["seq"])) == rows(spark.createDataFrame([(1, "a"), (2, "b"), (3, "f"), (None, "x"), (None, "y")], "id long, v string"))
    assert rows(mutate.upsert(t, n.drop("seq"), ["id"])) == rows(mutate.upsert(t, n.drop("seq").repartition(3), ["id"]))


def test_a_stopped_swap_is_recovered(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    (tmp_path / "t").rename(tmp_path / "_t.old")
    spark.range(5).write.parquet(str(tmp_path / "_t.new"))
    mutate.recover(spark, path)
    assert spark.read.parquet(path).count() == 5  # the new table was whole
    (tmp_path / "t").rename(tmp_path / "t.lost")
    (tmp_path / "_t.new").mkdir()
    mutate.recover(spark, path)
    assert spark.read.parquet(path).count() == 3  # it wasn't: the old one
    mutate.swap(spark.range(7), path)
    mutate.recover(spark, path)
    assert spark.read.parquet(path).count() == 7 and not (tmp_path / "_t.old").exists()


def test_metadata_that_raises_is_tried_again(spark, data):
    from prismalake.queries.scans import PHOTO, decoder
    from prismalake.sources.media import metadata_batch

    g = Gallery(spark, data)
    once = metadata_batch(g.photos.select(*PHOTO), g.cities, decoder)
    left = {r.id for r in once.filter("not is_metadata_extracted").collect()}
    assert left and all(i % 10 == 6 for i in left)
    again = metadata_batch(once, g.cities, lambda: lambda path: {"latitude": 1.0, "longitude": 1.0})
    assert again.filter("not is_metadata_extracted").count() == 0


def test_faces_stream_through_in_order(spark):
    """Batches of one row each give what one pass over everything gives."""
    from prismalake.plans.faces import assign_new_faces

    rng = np.random.default_rng(3)
    rows = [(k, k // 3, [float(x) for x in rng.normal(size=4)], 0.9, 1.0) for k in range(40)]
    faces = spark.createDataFrame(rows, "id long, photo_id long, embedding array<float>, quality double, weight double").repartition(5)
    want, at, now = [], 1, State()
    for photo in range(14):
        part = [{"embedding": r[2], "quality": r[3], "weight": r[4]} for r in rows if r[1] == photo]
        got, at = assign_photo(now, part, next_id=at)
        want += [x["person_id"] for x in got]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = sorted(assign_new_faces(faces, State()).collect(), key=lambda r: r.id)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [r.person_id for r in got] == want


def test_sitting():
    s = search.Sitting()
    first = s.submit("beach")
    assert s.remove_filter("dates") == first + 1 and s.remove_person(4) == first + 2
    assert not s.arrived(first, "late") and s.arrived(first + 2, "now") and s.result == "now"
    s.submit("other")
    assert s.use == search.FILTERS and not s.removed_persons
    s.submit(" ")
    assert s.result is None and s.run(None, date(2026, 7, 6)) is None


@pytest.mark.parametrize("buckets", [0, 5])
def test_sync(spark, tmp_path, buckets):
    cols = "id long, file_path string, file_size long, file_last_modified long"
    paths = sync.Tables(*(str(tmp_path / x) for x in ("photos", "analyses", "faces")), buckets)
    paths.write(spark.createDataFrame([(1, "u1", 10, 1), (2, "u2", 10, 1), (3, "u3", 10, 1)], cols), paths.photos, "id")
    for p in (paths.analyses, paths.faces):
        paths.write(spark.createDataFrame([(1,), (2,), (3,)], "photo_id long"), p, "photo_id")
    listing = spark.createDataFrame([(1, "u1", 10, 1), (2, "u2", 99, 1), (4, "u4", 1, 1)], cols)
    sync.sync(listing, listing.select("file_path"), paths)
    assert sorted(r.id for r in paths.read(spark, paths.photos).collect()) == [1, 2, 4]
    assert [r.photo_id for r in paths.read(spark, paths.faces).collect()] == [1]
    sync.sync(listing, None, paths)
    assert paths.read(spark, paths.photos).count() == 3
    # a path under another id, and an older state of the same photo in the same batch
    moved = spark.createDataFrame([(9, "u1", 10, 1), (2, "u2", 50, 0), (2, "u2", 77, 5)], cols)
    sync.sync(moved, None, paths)
    assert sorted((r.id, r.file_path, r.file_size) for r in paths.read(spark, paths.photos).collect()) == [(2, "u2", 77), (4, "u4", 1), (9, "u1", 10)]
    assert paths.read(spark, paths.faces).count() == 0


def test_a_sync_leaves_other_buckets_alone(spark, tmp_path):
    cols = "id long, file_path string, file_size long, file_last_modified long"
    paths = sync.Tables(*(str(tmp_path / x) for x in ("photos", "analyses", "faces")), 8)
    paths.write(spark.range(200).selectExpr("id", "concat('u', id) AS file_path", "10L AS file_size", "1L AS file_last_modified"), paths.photos, "id")
    for p in (paths.analyses, paths.faces):
        paths.write(spark.range(200).withColumnRenamed("id", "photo_id"), p, "photo_id")
    before = {f.parent.name: f.stat().st_mtime_ns for f in (tmp_path / "photos").glob("bucket=*/part-*")}
    sync.sync(spark.createDataFrame([(7, "u7", 11, 2)], cols), None, paths)
    after = {f.parent.name: f.stat().st_mtime_ns for f in (tmp_path / "photos").glob("bucket=*/part-*")}
    assert sum(before.get(k) != v for k, v in after.items()) == 1 and len(after) == 8
    assert paths.read(spark, paths.photos).count() == 200 and paths.read(spark, paths.faces).count() == 199


def test_stream(spark, tmp_path):
    cols = "id long, file_path string, file_size long, file_last_modified long"
    paths = sync.Tables(*(str(tmp_path / x) for x in ("photos", "analyses", "faces")))
    spark.createDataFrame([(1, "u1", 10, 1)], cols).write.parquet(paths.photos)
    for p in (paths.analyses, paths.faces):
        spark.createDataFrame([(1,)], "photo_id long").write.parquet(p)
    spark.createDataFrame([(1, "u1", 11, 1), (2, "u2", 5, 5)], cols).write.parquet(str(tmp_path / "in"))
    q = sync.sync_stream(spark.readStream.schema(cols).parquet(str(tmp_path / "in")), paths, str(tmp_path / "cp"))
    q.awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(paths.photos).collect())) == [(1, "u1", 11, 1), (2, "u2", 5, 5)]
    assert spark.read.parquet(paths.analyses).count() == 0


def test_analysis_queue(spark, data):
    g = Gallery(spark, data)

    def load():
        def encode(path):
            if path.endswith("7"):
                raise OSError("broken")
            return [1.0, 2.0]

        return encode

    rows = sync.run_analysis(g.photos, g.analyses, "clip_embedding", "m1", load, 5)
    got = rows.collect()
    assert {r.photo_id for r in got} == {r.id for r in ph.missing_analysis(g.photos, g.analyses, "clip_embedding", "m1").collect()}
    assert all((r.embedding is None) == (r.photo_id % 10 == 7) == bool(r.text_result) for r in got)
    done = g.analyses.select("photo_id", "analysis_type", "model_name").unionByName(spark.createDataFrame(got, rows.schema).select("photo_id", "analysis_type", "model_name"))
    assert ph.missing_analysis(g.photos, done, "clip_embedding", "m1").count() == 0


def test_retries():
    tries = []

    def fail():
        tries.append(1)
        raise ValueError

    with pytest.raises(ValueError):
        sync.with_retries(fail)
    assert len(tries) == 4


def test_model_config(tmp_path, spark):
    good = {"type": "face_detection", "name": "D 1", "files": {"detector": "d.onnx"}, "image_size": 640}
    c = models.parse_model_config(json.dumps(good))
    assert c.languages == ("en",) and c.max_tokens == 48 and c.supports_language("EN")
    for broken in ("{", "[]", json.dumps(good | {"type": "x"}), json.dumps(good | {"files": {}}), json.dumps(good | {"image_size": 0})):
        with pytest.raises(models.ModelError):
            models.parse_model_config(broken)
    (tmp_path / "m").mkdir()
    (tmp_path / "m/config.json").write_text(json.dumps(good))
    reg = spark.createDataFrame([], "id long, model_type string, model_name string, model_path string, is_active boolean, is_builtin boolean, added_at long")
    with pytest.raises(models.ModelError) as e:
        models.import_model(str(tmp_path / "m"), reg, str(tmp_path / "root"), 1, 5)
    assert e.value.reason == "missing_file"
    (tmp_path / "m/d.onnx").write_bytes(b"\x08\x01")
    after, _ = models.import_model(str(tmp_path / "m"), reg, str(tmp_path / "root"), 1, 5)
    assert after.first().is_active
    with pytest.raises(models.ModelError) as e:
        models.import_model(str(tmp_path / "m"), after, str(tmp_path / "root"), 2, 5)
    assert e.value.reason == "duplicate"
    assert models.delete_model(after, 1, str(tmp_path / "root")).count() == 0


def test_geonames(spark, tmp_path):
    line = lambda i, name, alt, pop: "\t".join([str(i), name, "", alt, "1.5", "2.5", "", "", "FR", "", "", "", "", "", pop])
    (tmp_path / "c.txt").write_text("\n".join([line(1, "Old", "", "5"), line(1, 'Par"is', "Lutèce,Париж,Paris", ""), "short\tline"]) + "\n")
    c = geonames.geonames_cities(spark, str(tmp_path / "c.txt"))
    assert [(r.id, r.name, r.population) for r in c.collect()] == [(1, 'Par"is', None)]
    assert sorted(r.alias for r in geonames.fallback_aliases(c).collect()) == ["Lutèce", "Paris"]
    (tmp_path / "a.txt").write_text("9\t1\ten\tParee\t\t\t1\t\n9\t1\ten\tPAREE\t\t\t\t\n9\t1\tfr\tx\t\t\t\t\n9\t2\ten\ty\t\t\t\t\n9\t1\ten\tParee\t\t\t\t\n")
    a = geonames.geonames_aliases(spark, str(tmp_path / "a.txt"), c)
    assert [r.alias for r in geonames.alias_dedup(a, c).collect()] == ["PAREE"]
    assert geonames.open_member([("readme.txt", 9), ("x/FR.txt", 5)], "/tmp/FR.zip") == "x/FR.txt"
    assert geonames.import_cities(c, a, str(tmp_path / "out"), "1") and not geonames.import_cities(c, a, str(tmp_path / "out"), "1")


def test_box_near_the_pole():
    lat0, lat1, lon0, lon1 = geo.box_of_radius(90.0, 0.0, 111.0)
    assert (lat0, lat1) == (89.0, 91.0) and lon1 == pytest.approx(100.0)


def test_search_gives_a_city_back_to_the_text(spark, data):
    g = Gallery(spark, data)
    lib = search.Library(g.photos, g.faces, g.analyses, g.persons, spark.createDataFrame([(1, "IMG", "C0", 80.0, 10.0, 5)], g.cities.schema), g.aliases.limit(0))
    lib = search.Library(lib.photos.withColumn("location_name", F.lit("IMG, C0")).filter("latitude < 60"), *[getattr(lib, f) for f in ("faces", "analyses", "persons", "cities", "aliases")])
    r = search.search(lib, "img", date(2026, 7, 6))
    assert r.parsed.place is None and r.parsed.text == "img" and r.photos.count() > 0
    assert search.search(lib, "x", date(2026, 7, 6)).photos.count() == 0
    kept = search.search(lib, "img", date(2026, 7, 6), use=frozenset())
    assert kept.parsed.text == "" and kept.photos.count() == 0


def test_recent():
    r = search.Recent(2)
    r["a"], r["b"] = 1, 2
    assert r["a"] == 1
    r["c"] = 3
    assert list(r) == ["a", "c"]


def test_plans(spark, data):
    g = Gallery(spark, data)
    plan = ph.hard_filter(g.photos, g.faces, ph.Criteria(persons=((1, False),)))._jdf.queryExecution().toString()
    assert "LeftSemi" in plan
    top = vectors.top_k(vectors.scored(g.analyses, [0.0] * 64), 5)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in top and "Python" not in top


def test_zero_sizes_do_not_divide(spark):
    from prismalake.functions.text import detect_media_type

    rows = spark.createDataFrame([(0, 0, 0.0), (0, 5, 0.0), (5, 0, 0.0)], "w int, h int, z double")
    kind = detect_media_type(F.lit("x"), F.lit(None).cast("string"), F.col("w"), F.col("h"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    z = F.col("z")
    marks = F.array(*[z] * 10)
    got = rows.select(kind.alias("k"), fc.yaw_proxy(marks).alias("y"), fc.pitch_proxy(marks).alias("p"), fc.box_aspect(z, z, z, z).alias("a"), fc.iou_columns((z, z, z, z), (z, z, z, z)).alias("i"), fc.embed_source_size(z, F.lit(1024), F.lit(768), F.lit(112), F.lit(3072)).alias("s"))
    assert {tuple(r) for r in got.collect()} == {(0, 0.0, 0.0, 0.0, 0.0, 1024)}


def many_faces(spark, n=2001, named=False):
    """More faces than one export of the app takes; vectors of two sizes, missing ones and one with a hole."""
    vector = lambda k: None if k % 501 == 7 else [0.5, None] if k == 11 else [k / 7] if k % 400 == 3 else [k / 3, 1.0 - k]
    rows = [(5 * k, None if k % 97 == 1 else k % 4, vector(k)) for k in range(n)]
    return rows, spark.createDataFrame(rows, "id long, person_id long, embedding array<float>").repartition(3)


def plain_pair(a, b):
    """What one pair of rows (id, person, vector) gives."""
    x, y = a[2], b[2]
    ok = x is not None and y is not None and len(x) == len(y) and None not in x + y
    sim = float(sum(np.float64(np.float32(p)) * np.float64(np.float32(q)) for p, q in zip(x, y, strict=True))) if ok else None
    return a[0], b[0], a[1], b[1], None if a[1] is None or b[1] is None else a[1] == b[1], sim


def test_face_pairs_of_any_number(spark, monkeypatch):
    """2,001 faces, which were refused, in pieces: all pairs, and the values of some."""
    monkeypatch.setattr(people, "PIECE", 300)
    rows, faces = many_faces(spark)
    got = people.face_pairs(faces)
    n = len(rows)
    assert got.count() == got.select("face_a", "face_b").distinct().count() == n * (n - 1) // 2
    some = rows[:20] + rows[400:412] + rows[-10:]
    want = {(a[0], b[0]): plain_pair(a, b) for i, a in enumerate(some) for b in some[i + 1 :]}
    ids = [r[0] for r in some]
    found = got.filter(got.face_a.isin(ids) & got.face_b.isin(ids)).select("face_a", "face_b", "person_a", "person_b", "same_person", "similarity").collect()
    assert len(found) == len(want)
    for r in found:
        assert tuple(r)[:5] == want[r.face_a, r.face_b][:5]
        sim = want[r.face_a, r.face_b][5]
        assert r.similarity is None if sim is None else r.similarity == pytest.approx(sim, rel=1e-12)


def test_stored_pairs_take_little_more_than_similarities(spark, tmp_path):
    """Eight bytes are the similarity; ids and the mark of 1,124,250 pairs take less than half of one, and every pair is there once."""
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(1500, 8)) / 3
    faces = spark.createDataFrame([(k, int(p), v.tolist()) for k, (p, v) in enumerate(zip(rng.integers(0, 10, 1500), vectors, strict=True))], "id long, person_id long, embedding array<float>")
    people.face_pairs(faces).select("face_a", "face_b", "same_person", F.round("similarity", 6).alias("similarity")).write.parquet(str(tmp_path / "pairs"))
    got, n = spark.read.parquet(str(tmp_path / "pairs")), 1500 * 1499 // 2
    assert got.filter("face_a < face_b").select("face_a", "face_b").distinct().count() == got.count() == n
    assert sum(p.stat().st_size for p in (tmp_path / "pairs").glob("part-*")) < 8.5 * n


def test_few_faces_have_no_pairs(spark):
    for n in (0, 1):
        assert people.face_pairs(many_faces(spark, n)[1]).collect() == []


def test_id_pairs_of_any_number(spark):
    rows, faces = many_faces(spark)
    got, n = people.id_pairs(faces), len(rows)
    assert got.filter("face_a < face_b").distinct().count() == got.count() == n * (n - 1) // 2
    assert people.id_pairs(faces.limit(1)).count() == 0


def test_export_of_any_number_of_pairs(spark, tmp_path):
    """2,001 faces, which were refused; names that are quoted, missing, or of nobody."""
    from prismalake.sources import exports

    rows, faces = many_faces(spark)
    names = {0: 'A, "B"', 1: None, 2: "C"}
    exports.export_face_pairs(faces, spark.createDataFrame(list(names.items()), "id long, name string"), str(tmp_path / "pairs"))
    got, n = spark.read.csv(str(tmp_path / "pairs"), header=True, escape="\\"), len(rows)
    assert got.columns == "same_person similarity face_a face_b person_a person_b name_a name_b".split()
    assert got.select("face_a", "face_b").distinct().count() == got.count() == n * (n - 1) // 2
    some = rows[:12]
    for a, b in zip(some, some[1:], strict=False):
        r = got.filter((got.face_a == a[0]) & (got.face_b == b[0])).first()
        _, _, p, q, same, sim = plain_pair(a, b)
        assert (r.same_person, r.person_a, r.person_b) == (str(int(bool(same))), p if p is None else str(p), q if q is None else str(q))
        assert (r.name_a, r.name_b) == (names.get(p), names.get(q))
        assert (r.similarity is None) == (sim is None) and (sim is None or float(r.similarity) == pytest.approx(sim, rel=1e-12))


def test_exported_pairs_take_little_disk(spark, tmp_path):
    """All pairs in under a third of the bytes of their text, and the same text."""
    import gzip

    from prismalake.sources import exports

    rows, faces = many_faces(spark, 300)
    persons = spark.createDataFrame([(0, 'A, "B"'), (1, None), (2, "C")], "id long, name string")
    exports.export_face_pairs(faces, persons, str(tmp_path / "small"))
    exports.export_face_pairs(faces, persons, str(tmp_path / "plain"), compression="none")
    small, plain = ([p for p in (tmp_path / d).iterdir() if p.name.startswith("part-")] for d in ("small", "plain"))
    assert sum(p.stat().st_size for p in small) * 3 < sum(p.stat().st_size for p in plain)
    lines = [sorted(x for t in texts for x in t.splitlines() if not x.startswith(b'"same_person"')) for texts in ([gzip.decompress(p.read_bytes()) for p in small], [p.read_bytes() for p in plain])]
    assert lines[0] == lines[1] and len(lines[0]) == len(rows) * (len(rows) - 1) // 2


@pytest.mark.parametrize("seed", range(6))
def test_blocks_of_faces_as_one_by_one(seed, monkeypatch):
    """Copies, opposites, holes, zeros, infinities, two dimensions, photos over several blocks: bit for bit the plain pass."""
    import pyarrow as pa

    from prismalake.plans import faces as pf

    rng = np.random.default_rng(seed)
    monkeypatch.setattr(pf, "BLOCK", 7)
    mixed = seed % 2  # else new persons come to ids that exist
    base = [rng.normal(size=d) for d in ((4, 4, 4, 3, 3) if mixed else (4,) * 5)]
    base = [v / np.linalg.norm(v) for v in base] + [np.zeros(4), np.array([np.nan, 1, 0, 0]), np.array([np.inf, 1, 0, 0])][: 2 + (seed > 2)]
    pick = lambda: base[rng.integers(len(base))] * rng.choice([1, 1, 1, -1]) + (rng.normal(size=1) * 0.2 if rng.random() < 0.5 else 0)
    photos = np.sort(rng.choice([1, 2, 3, *range(4, 60)], 300, p=[0.2, 0.1, 0.1, *[0.6 / 56] * 56]))
    rows = [{"id": k, "photo_id": int(p), "embedding": pick().astype(np.float32), "quality": float(rng.choice([0.1, 0.5, 0.9])), "weight": float(rng.choice([1.0, 1.5]))} for k, p in enumerate(photos)]
    start = lambda: State({1: base[0] * 2, 2: base[3]}, {2, 7}, {7: base[1], 8: base[1], 9: base[4]})
    with np.errstate(all="ignore"):
        want, at, now = [], 20 if mixed else 5, start()
        for photo in np.unique(photos):
            part = [r for r in rows if r["photo_id"] == photo]
            got, at = assign_photo(now, part, next_id=at)
            want += got
        batch = pa.RecordBatch.from_pydict({"embedding": pa.array([r["embedding"].tolist() for r in rows], pa.list_(pa.float32())), **{c: [r[c] for r in rows] for c in ("id", "photo_id", "quality", "weight")}})
        walk, got = pf._Pass(start(), False, 20 if mixed else 5), []
        while len(got) < len(rows):
            got += walk.block(batch.slice(len(got), walk.size())).to_pylist()
    of = lambda x: (x["person_id"], x["assignment_type"], x["exclusion_reason"], repr(x["similarity"]))
    assert [of(g) for g in got] == [of(w) for w in want]


def test_many_faces_of_many_people(monkeypatch):
    """A face costs one look at the centroids' products, not a Python step a centroid."""
    import pyarrow as pa

    from prismalake.plans import faces as pf

    n, asked = 4000, []
    monkeypatch.setattr(State, "centroid", lambda self, p, f=State.centroid: asked.append(p) or f(self, p))
    vectors = np.random.default_rng(1).normal(size=(n, 64)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    walk, k = pf._Pass(State(), False, 1), 0
    batch = pa.RecordBatch.from_pydict({"id": np.arange(n), "photo_id": np.arange(n), "embedding": pa.ListArray.from_arrays(np.arange(0, 64 * n + 1, 64, dtype=np.int32), vectors.ravel()), "quality": np.ones(n), "weight": np.ones(n)})
    while k < n:
        k += walk.block(batch.slice(k, walk.size())).num_rows
    assert len(asked) < n and len(walk.dims) > 1000


def test_faces_without_a_photo_are_kept(spark):
    """Each is a photo of its own, so that two of them may be one person; a face without a vector is told."""
    from prismalake.plans.faces import assign_new_faces

    cols = "id long, photo_id long, embedding array<float>, quality double, weight double"
    faces = spark.createDataFrame([(1, None, [1.0, 0.0], 0.9, 1.0), (2, None, [1.0, 0.0], 0.9, 1.0), (3, 5, [0.0, 1.0], 0.9, 1.0)], cols)
    assert {r.id: r.person_id for r in assign_new_faces(faces, State()).collect()} == {1: 1, 2: 1, 3: 2}
    with pytest.raises(Exception, match="face 4 has no embedding"):
        assign_new_faces(spark.createDataFrame([(4, 5, None, 0.9, 1.0)], cols), State()).collect()
