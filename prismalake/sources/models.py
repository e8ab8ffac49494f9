"""Model configurations and the model registry."""

from __future__ import annotations

import json
import os
import shutil
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import mutate

TYPES = ("clip", "translation", "captioning", "tagging", "face_detection", "face_embedding", "ocr")
#: Files that each type needs, by role.
FILES = {
    "clip": ("image_encoder", "text_encoder", "tokenizer"),
    "translation": ("encoder", "decoder", "tokenizer_source", "tokenizer_target"),
    "face_detection": ("detector",),
    "face_embedding": ("embedder",),
}
TOKENIZERS = ("clip_bpe", "sentencepiece_bpe", "unigram")


class ModelError(ValueError):
    """Why a model can't be imported: ``reason`` is one of a closed set."""

    REASONS = ("unreadable", "invalid_config", "duplicate", "missing_file", "invalid_model", "copy_failed")

    def __init__(self, reason: str, message: str) -> None:
        super().__init__(message)
        self.reason = reason


@dataclass(frozen=True)
class ModelConfig:
    type: str
    name: str
    files: dict[str, str]
    embedding_dim: int | None = None
    image_size: int | None = None
    tokenizer: str | None = None
    context_length: int | None = None
    languages: tuple[str, ...] = ("en",)
    channel_order: str = "rgb"
    normalization: str = "mean_std"
    resize: str = "center_crop"
    max_tokens: int = 48
    similarity_floor: float | None = None
    prompt_template: str | None = None
    extra: dict = field(default_factory=dict)

    def supports_language(self, code: str) -> bool:
        return code.lower() in {x.lower() for x in self.languages}


def parse_model_config(text: str) -> ModelConfig:
    """A configuration from JSON; what its type needs and lacks raises ModelError."""
    try:
        raw = json.loads(text)
    except ValueError as e:
        raise ModelError("invalid_config", f"not JSON: {e}") from e
    bad = lambda m: ModelError("invalid_config", m)
    if not isinstance(raw, dict):
        raise bad("not an object")
    kind, name, files = raw.get("type"), raw.get("name"), raw.get("files")
    if kind not in TYPES:
        raise bad(f"unknown type {kind!r}")
    if not isinstance(name, str) or not name.strip():
        raise bad("no name")
    if not isinstance(files, dict) or not files:
        raise bad("no files")
    lacking = [r for r in FILES.get(kind, ()) if not files.get(r)]
    if lacking:
        raise bad(f"no file for {', '.join(lacking)}")
    needs = {"clip": ("embedding_dim", "image_size", "tokenizer", "context_length"), "face_detection": ("image_size",), "face_embedding": ("embedding_dim", "image_size")}
    for key in needs.get(kind, ()):
        if raw.get(key) is None:
            raise bad(f"no {key}")
        if key != "tokenizer" and (not isinstance(raw[key], int) or raw[key] <= 0):
            raise bad(f"{key} must be a positive number")
    if raw.get("tokenizer") is not None and raw["tokenizer"] not in TOKENIZERS:
        raise bad(f"unknown tokenizer {raw['tokenizer']!r}")
    names = {f for f in ModelConfig.__dataclass_fields__ if f not in ("extra", "languages", "files")}
    known = {k: v for k, v in raw.items() if k in names and v is not None}
    return ModelConfig(files={k: str(v) for k, v in files.items()}, languages=tuple(raw.get("languages") or ("en",)), extra={k: v for k, v in raw.items() if k not in names | {"languages", "files"}}, **known)


def looks_like_onnx(path: str) -> bool:
    """A non-empty file whose first byte is the tag of a model's version field."""
    with open(path, "rb") as f:
        return f.read(1) == b"\x08"


def import_model(folder: str, models: DataFrame, root: str, new_id: int, now: int, valid: Callable[[str], bool] = looks_like_onnx) -> tuple[DataFrame, ModelConfig]:
    """The registry with the model of a folder; its files are copied below ``root``, and removed again if anything fails.

    The first model of its type becomes the active one.
    """
    try:
        with open(os.path.join(folder, "config.json"), encoding="utf-8") as f:
            config = parse_model_config(f.read())
    except OSError as e:
        raise ModelError("unreadable", str(e)) from e
    same = models.filter((F.col("model_type") == config.type) & (F.col("model_name") == config.name))
    if same.limit(1).count():
        raise ModelError("duplicate", f"{config.type} {config.name} is there already")
    for f in config.files.values():
        path = os.path.join(folder, f)
        if not os.path.isfile(path):
            raise ModelError("missing_file", f)
        if f.endswith(".onnx") and not valid(path):
            raise ModelError("invalid_model", f)
    target = os.path.join(root, config.type, "".join(c if c.isalnum() or c in "._-" else "_" for c in config.name))
    try:
        os.makedirs(target)
        for f in ("config.json", *config.files.values()):
            shutil.copy(os.path.join(folder, f), os.path.join(target, os.path.basename(f)))
    except OSError as e:
        shutil.rmtree(target, ignore_errors=True)
        raise ModelError("copy_failed", str(e)) from e
    first = not models.filter(F.col("model_type") == config.type).limit(1).count()
    values = {"id": new_id, "model_type": config.type, "model_name": config.name, "model_path": target, "is_active": first, "is_builtin": False, "added_at": now}
    row = models.sparkSession.range(1).select(*(F.lit(values.get(c)).cast(k).alias(c) for c, k in models.dtypes))
    return models.unionByName(row), config


def delete_model(models: DataFrame, model_id: int, root: str) -> DataFrame:
    """The registry without a model; its files go only if they lie below ``root``."""
    row = models.filter(F.col("id") == model_id).first()
    path = row.asDict().get("model_path") if row else None
    if path and os.path.commonpath([os.path.realpath(path), os.path.realpath(root)]) == os.path.realpath(root):
        shutil.rmtree(path, ignore_errors=True)
    return mutate.delete_where(models, F.col("id") == model_id)


#: What activating a model of a type must be confirmed for.
CONFIRM = {"clip": "reindex", "face_detection": "reanalyse faces", "face_embedding": "reanalyse faces"}


def activation(models: DataFrame, model_id: int) -> tuple[str, str | None]:
    """("none" | "confirm" | "activate", what to confirm) for a wish to activate a model."""
    row = models.filter(F.col("id") == model_id).first()
    if row is None or row.is_active:
        return "none", None
    what = CONFIRM.get(row.model_type)
    return ("confirm", what) if what else ("activate", None)


def storage_sizes(folder: str) -> int:
    """Bytes of the files below a folder; 0 if there is none."""
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)
