"""CSV exports of face measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import faces as fc
from ..operators.people import face_pairs


def named_pairs(faces: DataFrame, persons: DataFrame) -> DataFrame:
    """All pairs of an export's faces: whether they are one person (1 or 0), similarity, ids and names."""
    names = persons.select(F.col("id").alias("person_id"), "name")
    pairs = face_pairs(faces.select("id", "person_id", "embedding").join(names, "person_id", "left"), ["name"], tile=1)
    same = F.coalesce(F.col("same_person"), F.lit(False)).cast("int").alias("same_person")
    return pairs.select(same, "similarity", "face_a", "face_b", "person_a", "person_b", "name_a", "name_b")


def export_face_pairs(faces: DataFrame, persons: DataFrame, path: str, compression: str = "gzip") -> None:
    """The pairs as CSV; names are quoted. A pair takes about 65 bytes of text, and a fourth of that in gzip; ``none`` writes plain text."""
    named_pairs(faces, persons).write.mode("overwrite").csv(path, header=True, quoteAll=True, compression=compression)


def face_metrics(stored: DataFrame, detected: DataFrame, persons: DataFrame, photos: DataFrame) -> DataFrame:
    """The 23 measures of the detected face that best overlaps each stored one (from 0.5).

    ``detected`` has photo_id, det_id, box_*, landmarks, score, cls, obj, rmse,
    scale, roll, blur, photo_blur, brightness, contrast; pixels are those of the
    original photo.
    """
    best = fc.match_boxes(stored, detected).select("id", "det_id")
    left, top, right, bottom = fc.boxes()
    of = stored.select("id", "photo_id", "person_id")
    size = photos.select(F.col("id").alias("photo_id"), F.coalesce("width", F.lit(0)).cast("long").alias("pw"), F.coalesce("height", F.lit(0)).cast("long").alias("ph"))
    names = persons.select(F.col("id").alias("person_id"), "name")
    rows = best.join(detected.drop("photo_id"), "det_id").join(of, "id").join(size, "photo_id").join(names, "person_id", "left")
    m = F.col("landmarks")
    return rows.select(
        F.col("id").alias("face_id"), "person_id", F.coalesce("name", F.lit("")).alias("name"), fc.face_quality(F.col("score"), F.col("scale"), F.col("blur")).alias("quality"),
        F.col("score").alias("det_score"), F.col("cls").alias("det_cls"), F.col("obj").alias("det_obj"), (right - left).alias("box_w"), (bottom - top).alias("box_h"),
        fc.box_aspect(left, top, right, bottom).alias("box_aspect"), ((right - left) * F.col("pw")).alias("face_px"), (fc.eye_distance(m) * F.col("pw")).alias("eye_dist_px"),
        (F.col("pw") * F.col("ph")).alias("photo_px"), fc.edge_margin(left, top, right, bottom).alias("edge_margin"), F.col("rmse").alias("align_rmse"), F.col("scale").alias("align_scale"),
        F.col("roll").alias("align_roll_deg"), fc.yaw_proxy(m).alias("yaw"), fc.pitch_proxy(m).alias("pitch"), "blur", "photo_blur", "brightness", "contrast",
    )


def export_face_metrics(stored: DataFrame, detected: DataFrame, persons: DataFrame, photos: DataFrame, path: str) -> None:
    """The measures as CSV, a row a matched face; names are quoted."""
    face_metrics(stored, detected, persons, photos).write.mode("overwrite").csv(path, header=True, quoteAll=True)
