"""Model inference with pluggable sessions; no weights are shipped.

A session is a callable from named numpy inputs to named numpy outputs, opened
once a worker task. Everything around it (prompts, tensors, output choice,
letterboxing, greedy decoding) is here and runs in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions import faces as fc
from ..sources.models import ModelConfig
from .search import Recent

Session = Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]
#: Sides at which faces are cut out, and the crop's own.
BASE, MOST, CROP = 1024, 3072, 112


def unit(v: np.ndarray) -> np.ndarray:
    n = float(np.sqrt((np.asarray(v, np.float64) ** 2).sum()))
    return (v / np.float32(n)).astype(np.float32) if n > 0 else np.asarray(v, np.float32)


def pick_embedding(outputs: dict[str, np.ndarray], dim: int | None, text: bool) -> np.ndarray:
    """The unit embedding among a model's outputs: the named one, then any ``embeds``, ``pooler``, or one of the right width."""
    flat = {k: v for k, v in outputs.items() if np.ndim(v) == 2}
    tests = (
        lambda k, v: k == ("text_embeds" if text else "image_embeds"),
        lambda k, v: "embeds" in k,
        lambda k, v: "pooler" in k,
        lambda k, v: dim is None or v.shape[-1] == dim,
    )
    name = next((k for test in tests for k, v in flat.items() if test(k, v)), None)
    if name is None:
        raise ValueError(f"no two-dimensional embedding among {sorted(outputs)}")
    v = np.asarray(flat[name][0], np.float32)
    if dim is not None and len(v) != dim:
        raise ValueError(f"output {name} has {len(v)} places, not {dim}")
    return unit(v)


def encode_text(text: str, config: ModelConfig, tokenizer, session: Session) -> np.ndarray:
    prompt = config.prompt_template.replace("{}", text) if config.prompt_template else text
    got = tokenizer.encode(prompt)
    ids, mask = got if isinstance(got, tuple) else (got, [1] * len(got))
    return pick_embedding(session({"input_ids": np.array([ids]), "attention_mask": np.array([mask])}), config.embedding_dim, True)


def resized(rgb: np.ndarray, width: int, height: int) -> np.ndarray:
    """Nearest-neighbour resampling."""
    y = np.minimum((np.arange(height) + 0.5) * rgb.shape[0] / height, rgb.shape[0] - 1).astype(int)
    x = np.minimum((np.arange(width) + 0.5) * rgb.shape[1] / width, rgb.shape[1] - 1).astype(int)
    return rgb[y][:, x]


def model_image(rgb: np.ndarray, size: int, mode: str = "center_crop") -> np.ndarray:
    """A square image: the middle of the picture, or all of it squashed."""
    if mode != "squash":
        side = min(rgb.shape[:2])
        y, x = (rgb.shape[0] - side) // 2, (rgb.shape[1] - side) // 2
        rgb = rgb[y : y + side, x : x + side]
    return resized(rgb, size, size)


def encode_image(rgb: np.ndarray, config: ModelConfig, session: Session, mean=(0.5, 0.5, 0.5), std=(0.5, 0.5, 0.5)) -> np.ndarray:
    image = model_image(rgb, config.image_size, config.resize)
    return pick_embedding(session({"pixel_values": fc.image_tensor(image, mean, std)[None]}), config.embedding_dim, False)


def fitted(rgb: np.ndarray, size: int) -> np.ndarray:
    """The picture inside a square of ``size``, its shape kept."""
    scale = size / max(rgb.shape[:2])
    return resized(rgb, max(1, round(rgb.shape[1] * scale)), max(1, round(rgb.shape[0] * scale)))


def detection_canvas(rgb: np.ndarray, size: int) -> tuple[np.ndarray, int, int]:
    """The fitted picture in the top left corner of a black square, and its own width and height."""
    inner = fitted(rgb, size)
    out = np.zeros((size, size, 3), inner.dtype)
    out[: inner.shape[0], : inner.shape[1]] = inner
    return out, inner.shape[1], inner.shape[0]


def locate_faces(rgb: np.ndarray, size: int, levels: Callable[[np.ndarray], list[tuple]], score: float = 0.6, overlap: float = 0.3, smallest: float | None = None) -> list[dict]:
    """Faces as shares of the picture: letterbox, detect, decode, suppress, drop small ones; boxes are clamped, landmarks aren't."""
    canvas, width, height = detection_canvas(rgb, size)
    found = fc.decode_levels(levels(canvas), score, overlap)
    if smallest is not None:
        found = [f for f in found if f["box"][2] - f["box"][0] >= smallest and f["box"][3] - f["box"][1] >= smallest]
    by = np.array([width, height])
    return [{"score": f["score"], "box": np.clip(np.array(f["box"]) / np.tile(by, 2), 0, 1).tolist(), "landmarks": (np.array(f["landmarks"]) / np.tile(by, 5)).tolist()} for f in found]


def embedding_source(rgb: np.ndarray, faces: Sequence[dict], crop: int = CROP) -> np.ndarray:
    """The picture at 1024, or larger so that the smallest face fills the crop, at most 3072."""
    base = fitted(rgb, BASE)
    px = min(f["box"][2] - f["box"][0] for f in faces) * base.shape[1]
    size = BASE if px <= 0 or crop / px <= 1 else min(max(int(BASE * (crop / px)), BASE), MOST)
    return base if size <= BASE else fitted(rgb, size)


def align_face(rgb: np.ndarray, landmarks: Sequence[float], crop: int = CROP) -> tuple[np.ndarray, tuple[float, ...]]:
    """The face turned upright and scaled onto the template, and the transform that does it."""
    marks = np.reshape(landmarks, (-1, 2)) * np.array([rgb.shape[1], rgb.shape[0]])
    t = fc.similarity_transform(marks.ravel(), np.array(fc.TEMPLATE) * crop / 112)
    a, b, tx, ty = t
    y, x = np.mgrid[:crop, :crop]
    n = a * a + b * b
    u, v = (a * (x - tx) + b * (y - ty)) / n, (a * (y - ty) - b * (x - tx)) / n
    inside = (u >= 0) & (v >= 0) & (u < rgb.shape[1]) & (v < rgb.shape[0])
    out = np.zeros((crop, crop, 3), rgb.dtype)
    out[inside] = rgb[v[inside].astype(int), u[inside].astype(int)]
    return out, t


def embed_face(crop: np.ndarray, session: Session, dim: int | None = None) -> np.ndarray:
    return pick_embedding(session({"input": fc.image_tensor(crop)[None]}), dim, False)


def face_metrics(crop: np.ndarray, t: tuple[float, ...], face: dict) -> dict[str, float]:
    """Measures of an aligned face."""
    gray = fc.grayscale(crop)
    mean, std = fc.grayscale_mean_std(gray)
    m, box = face["landmarks"], face["box"]
    return {
        "detection": face["score"], "scale": fc.similarity_scale(t), "roll": fc.roll_degrees(t), "blur": fc.laplacian_variance(gray, crop.shape[1], crop.shape[0]), "mean": mean, "std": std,
        "eye_distance": float(np.hypot(m[2] - m[0], m[3] - m[1])), "edge_margin": min(box[0], box[1], 1 - box[2], 1 - box[3]), "aspect": (box[2] - box[0]) / (box[3] - box[1]) if box[3] > box[1] else 0.0,
    }


def analyze_faces(rgb: np.ndarray, size: int, levels, session: Session, dim: int | None = None) -> list[dict]:
    """Located faces with embedding, measures and quality."""
    found = locate_faces(rgb, size, levels)
    if not found:
        return []
    source, out = embedding_source(rgb, found), []
    for f in found:
        crop, t = align_face(source, f["landmarks"])
        m = face_metrics(crop, t, f)
        sharp = np.clip((np.log10(max(m["blur"], 0.01)) - 0.5) / 2, 0, 1)
        quality = float(np.clip(f["score"], 0, 1) * min(1 / max(m["scale"], 1e-3), 2) / 2 * sharp)
        out.append({**f, "embedding": embed_face(crop, session, dim).tolist(), "quality": quality, "metrics": m})
    return out


def encode_column(rows: DataFrame, load: Callable[[], Callable], id_col: str, in_col: str) -> DataFrame:
    """(id, embedding) of each row; ``load`` opens a session once a task and returns value -> vector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load()
        for b in batches:
            yield pd.DataFrame({id_col: b[id_col], "embedding": [None if v is None else [float(x) for x in encode(v)] for v in b[in_col]]})

    return rows.select(id_col, in_col).mapInPandas(run, f"{id_col} {rows.select(id_col).schema[0].dataType.simpleString()}, embedding array<float>")


@dataclass
class Translator:
    """Greedy translation behind a language gate, with the last results kept; any failure is None."""

    config: ModelConfig
    source_languages: Sequence[str]
    target_language: str
    encode: Callable[[str], np.ndarray]
    step: Callable[[np.ndarray, list[int]], np.ndarray]
    decode: Callable[[list[int]], str]
    start: int = 0
    end: int = 1

    def __post_init__(self) -> None:
        self.recent = Recent(50)

    def translate(self, text: str, language: str, accepted: Sequence[str] = ()) -> str | None:
        low = lambda xs: {x.lower() for x in xs}
        if language.lower() not in low(self.source_languages) or accepted and self.target_language.lower() not in low(accepted):
            return None
        if text in self.recent:
            return self.recent[text]
        try:
            state, ids = self.encode(text), [self.start]
            while len(ids) <= self.config.max_tokens:
                best = int(np.argmax(self.step(state, ids)))
                if best == self.end:
                    break
                ids.append(best)
            out = self.decode(ids[1:]).strip()
        except Exception:  # a broken translator must not end a search; the raw text is searched instead
            return None
        if not out:
            return None
        self.recent[text] = out
        return out
