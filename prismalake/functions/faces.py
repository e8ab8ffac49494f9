"""Face geometry: columns where arithmetic is enough, numpy where loops are the point."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed landmarks of an upright face in a 112-pixel crop: eyes, nose, mouth corners.
TEMPLATE = (38.2946, 51.6963, 73.5318, 51.5014, 56.0252, 71.7366, 41.5493, 92.3655, 70.7299, 92.2041)


def _pitch(m) -> float:
    ex, ey = m[2] - m[0], m[3] - m[1]
    nx, ny = m[4] - (m[0] + m[2]) / 2, m[5] - (m[1] + m[3]) / 2
    return (ny * ex - nx * ey) / (ex * ex + ey * ey)


TEMPLATE_PITCH = _pitch(TEMPLATE)


def _eyes(m: Column) -> tuple[Column, ...]:
    ex, ey = m[2] - m[0], m[3] - m[1]
    return ex, ey, m[4] - (m[0] + m[2]) / 2, m[5] - (m[1] + m[3]) / 2


def eye_distance(m: Column) -> Column:
    return F.hypot(m[2] - m[0], m[3] - m[1])


def yaw_proxy(m: Column) -> Column:
    """Offset of the nose along the eye axis by eye distances; 0 without a distance."""
    ex, ey, nx, ny = _eyes(m)
    return F.when(eye_distance(m) > 0, (nx * ex + ny * ey) / F.nullif(ex * ex + ey * ey, F.lit(0.0))).otherwise(0.0)


def pitch_proxy(m: Column) -> Column:
    """Offset of the nose across the eye axis, 0 for the template's face."""
    ex, ey, nx, ny = _eyes(m)
    return F.when(eye_distance(m) > 0, (ny * ex - nx * ey) / F.nullif(ex * ex + ey * ey, F.lit(0.0)) - F.lit(TEMPLATE_PITCH)).otherwise(0.0)


def edge_margin(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return F.least(left, top, 1 - right, 1 - bottom)


def box_aspect(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return F.when(bottom - top <= 0, 0.0).otherwise((right - left) / F.nullif(bottom - top, F.lit(0.0)))


def clamp(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def face_quality(detection: Column, scale: Column, blur: Column) -> Column:
    """Product of detection score, enlargement and sharpness, each 0 to 1."""
    size = F.least(1 / F.greatest(scale, F.lit(1e-3)), F.lit(2.0)) / 2
    return clamp(detection) * size * clamp((F.log10(F.greatest(blur, F.lit(0.01))) - 0.5) / 2)


def iou_columns(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Overlap of two boxes (left, top, right, bottom) by their union; 0 for an empty union."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return F.when(union > 0, w * h / F.nullif(union, F.lit(0.0))).otherwise(0.0)


def boxes(prefix: str = "box_") -> tuple[Column, ...]:
    return tuple(F.col(f"{prefix}{s}") for s in ("left", "top", "right", "bottom"))


def match_boxes(stored: DataFrame, detected: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The best overlapping detected box of each stored one in its photo, from ``threshold``: (id, det_id, iou)."""
    d = detected.select("photo_id", "det_id", *(F.col(f"box_{s}").alias(f"d_{s}") for s in ("left", "top", "right", "bottom")))
    pairs = stored.join(d, "photo_id").select("id", "det_id", iou_columns(boxes(), boxes("d_")).alias("iou"))
    best = pairs.groupBy("id").agg(F.max(F.struct("iou", (-F.col("det_id")).alias("d"))).alias("b"))
    return best.select("id", (-F.col("b.d")).alias("det_id"), F.col("b.iou").alias("iou")).filter(F.col("iou") >= threshold)


def filter_min_size(faces: DataFrame, smallest: float | None) -> DataFrame:
    """Faces both of whose sides reach a size; all of them without one."""
    if smallest is None:
        return faces
    left, top, right, bottom = boxes()
    return faces.filter((right - left >= smallest) & (bottom - top >= smallest))


def normalized_box(left: Column, top: Column, right: Column, bottom: Column, width: Column, height: Column) -> tuple[Column, ...]:
    """Pixels to shares of the image, clamped to it (landmarks are divided but not clamped)."""
    return clamp(left / width), clamp(top / height), clamp(right / width), clamp(bottom / height)


def to_pixels(points: Column, width: Column, height: Column) -> Column:
    return F.transform(points, lambda x, i: x * F.when(i % 2 == 0, width).otherwise(height))


def embed_source_size(smallest: Column, base: Column, base_width: Column, crop: Column, most: Column) -> Column:
    """Side to decode at so that the smallest face fills the crop, from ``base`` to ``most``."""
    px = F.nullif(smallest * base_width, F.lit(0.0))
    return F.when(px.isNull() | (px <= 0) | (crop / px <= 1), base).otherwise(F.least(F.greatest(F.floor(base * (crop / px)), base), most)).cast("int")


def face_crop_rect(left: float, top: float, right: float, bottom: float, width: int, height: int, grow: float = 1.5) -> tuple[int, int, int, int]:
    """Square crop around a face (shares of the image), moved inside the image: left, top, right, bottom in pixels."""
    side = int(min(max((right - left) * width, (bottom - top) * height) * grow, width, height))
    x = min(max(int((left + right) / 2 * width - side / 2), 0), width - side)
    y = min(max(int((top + bottom) / 2 * height - side / 2), 0), height - side)
    return x, y, x + side, y + side


def source_size_for(left: Column, top: Column, right: Column, bottom: Column, output: Column, most: Column, grow: float = 1.5) -> Column:
    """Side to decode a picture at so that the square cut out around a face has ``output`` pixels, from ``output`` to ``most``."""
    span = F.greatest(right - left, bottom - top) * F.lit(grow)
    need = F.ceil(output / F.nullif(span, F.lit(0.0)))
    return F.when(span <= 0, output).otherwise(F.least(F.greatest(need, output), most)).cast("int")


def stride_union(levels: Sequence[DataFrame]) -> DataFrame:
    """Candidates of all detector levels (the same columns, a level each), before suppression."""
    return reduce(DataFrame.unionByName, levels)


# ---- numpy


def iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Overlaps of box ``a`` with boxes ``b``."""
    w = np.maximum(np.minimum(a[2], b[:, 2]) - np.maximum(a[0], b[:, 0]), 0)
    h = np.maximum(np.minimum(a[3], b[:, 3]) - np.maximum(a[1], b[:, 1]), 0)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1]) - w * h
    return np.divide(w * h, union, out=np.zeros(len(b)), where=union > 0)


def nms(b: np.ndarray, scores: np.ndarray, threshold: float) -> list[int]:
    """Places kept: best score first (earlier on ties), without boxes that overlap a kept one by more than ``threshold``."""
    left = np.argsort(-scores, kind="stable")
    kept: list[int] = []
    while len(left):
        k, left = int(left[0]), left[1:]
        kept.append(k)
        left = left[iou(b[k], b[left]) <= threshold]
    return kept


def nms_per_photo(faces: DataFrame, threshold: float) -> DataFrame:
    """Faces that survive suppression in their photo (columns box_*, score, id, photo_id); a photo's faces are few."""

    def run(pdf):
        pdf = pdf.sort_values("id")
        return pdf.iloc[nms(pdf[["box_left", "box_top", "box_right", "box_bottom"]].to_numpy(float), pdf["score"].to_numpy(float), threshold)]

    cols = faces.select("photo_id", "id", "box_left", "box_top", "box_right", "box_bottom", "score")
    return cols.groupBy("photo_id").applyInPandas(run, cols.schema)


def decode_stride(cls: np.ndarray, obj: np.ndarray, bbox: np.ndarray, kps: np.ndarray, stride: int, cols: int, threshold: float) -> list[dict]:
    """Boxes of one detector level: score, box and five landmarks of each cell that reaches the threshold."""
    score = np.sqrt(np.clip(cls, 0, 1) * np.clip(obj, 0, 1))
    bbox, kps = np.reshape(bbox, (-1, 4)), np.reshape(kps, (-1, 5, 2))
    out = []
    for k in np.flatnonzero(score >= threshold):
        cell = np.array([k % cols, k // cols], float)
        centre, half = (cell + bbox[k, :2]) * stride, np.exp(bbox[k, 2:]) * stride / 2
        out.append({"score": float(score[k]), "box": [*(centre - half), *(centre + half)], "landmarks": ((cell + kps[k]) * stride).ravel().tolist()})
    return out


def decode_levels(levels: list[tuple], threshold: float, overlap: float) -> list[dict]:
    """All levels together, then suppression."""
    found = [f for level in levels for f in decode_stride(*level, threshold)]
    if not found:
        return []
    return [found[k] for k in nms(np.array([f["box"] for f in found]), np.array([f["score"] for f in found]), overlap)]


def similarity_transform(source: np.ndarray, target: np.ndarray) -> tuple[float, float, float, float]:
    """(a, b, tx, ty) of the least-squares rotation, scaling and shift of points onto points."""
    p, q = (np.reshape(np.asarray(x, np.float32), (-1, 2)).astype(np.float64) for x in (source, target))
    p0, q0 = p - p.mean(0), q - q.mean(0)
    energy = (p0**2).sum()
    if energy <= 0:
        raise ValueError("the source points coincide")
    a = (p0 * q0).sum() / energy
    b = (p0[:, 0] * q0[:, 1] - p0[:, 1] * q0[:, 0]).sum() / energy
    tx, ty = q.mean(0) - np.array([a * p[:, 0].mean() - b * p[:, 1].mean(), b * p[:, 0].mean() + a * p[:, 1].mean()])
    return float(a), float(b), float(tx), float(ty)


def similarity_scale(t: tuple[float, ...]) -> float:
    return float(np.hypot(t[0], t[1]))


def roll_degrees(t: tuple[float, ...]) -> float:
    return float(np.degrees(np.arctan2(t[1], t[0])))


def alignment_residual(t: tuple[float, ...], source: np.ndarray, target: np.ndarray) -> float:
    """Root mean square distance of the moved points from their targets."""
    p, q = (np.reshape(np.asarray(x, float), (-1, 2)) for x in (source, target))
    moved = np.stack([t[0] * p[:, 0] - t[1] * p[:, 1] + t[2], t[1] * p[:, 0] + t[0] * p[:, 1] + t[3]], 1)
    return float(np.sqrt(((moved - q) ** 2).sum(1).mean()))


def laplacian_variance(gray: np.ndarray, width: int, height: int) -> float:
    """Population variance of the four-neighbour Laplacian inside the image; 0 under 3 pixels a side."""
    if width < 3 or height < 3:
        return 0.0
    g = np.reshape(np.asarray(gray, float), (height, width))
    return float((g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]).var())


def grayscale_mean_std(gray: np.ndarray) -> tuple[float, float]:
    g = np.asarray(gray, float)
    return (float(g.mean()), float(g.std())) if g.size else (0.0, 0.0)


def grayscale(rgb: np.ndarray) -> np.ndarray:
    """Luma by the fixed weights 0.299, 0.587, 0.114."""
    return np.asarray(rgb, float) @ np.array([0.299, 0.587, 0.114])


def image_tensor(rgb: np.ndarray, mean=(0.5, 0.5, 0.5), std=(0.5, 0.5, 0.5), bgr: bool = False) -> np.ndarray:
    """Height x width x 3 bytes to 3 x height x width floats: normalised, then channels reordered."""
    x = (np.asarray(rgb, np.float32) / 255 - np.asarray(mean, np.float32)) / np.asarray(std, np.float32)
    return np.ascontiguousarray((x[..., ::-1] if bgr else x).transpose(2, 0, 1))


def encode_rows(rows: DataFrame, load: Callable[[], Callable], columns: str, schema: str) -> DataFrame:
    """Run a model over rows: ``load`` opens a session once a worker task, its callable maps a pandas batch to a pandas batch."""

    def run(batches: Iterator) -> Iterator:
        session = load()
        for b in batches:
            yield session(b)

    return rows.select(*columns.split()).mapInPandas(run, schema)
