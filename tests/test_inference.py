"""What surrounds a model, with models that answer by rule."""

import numpy as np
import pytest

from prismalake.functions import faces as fc
from prismalake.functions import tokenizers as tk
from prismalake.plans import actions, inference
from prismalake.sources.models import ModelConfig, activation, storage_sizes

CONFIG = ModelConfig("clip", "m", {}, embedding_dim=2, image_size=4, tokenizer="unigram", prompt_template="a photo of {}")


def test_choice_of_output():
    pick = lambda **o: inference.pick_embedding({k: np.array([v], float) for k, v in o.items()}, 2, True).tolist()
    assert pick(pooler=[1, 0], text_embeds=[0, 2]) == [0, 1]
    assert pick(pooler=[1, 0], my_embeds=[0, 2]) == [0, 1]
    assert pick(other=[1, 2, 3], pooler_output=[3, 0]) == [1, 0]
    assert pick(x=[1, 2, 3], y=[0, 5]) == [0, 1]
    with pytest.raises(ValueError):
        inference.pick_embedding({"x": np.zeros((1, 2, 3))}, 2, True)
    with pytest.raises(ValueError):
        pick(text_embeds=[1, 2, 3])


def test_prompt():
    seen = {}

    class Words:
        def encode(self, text):
            seen["text"] = text
            return [1, 2, 3]

    inference.encode_text("cat", CONFIG, Words(), lambda x: seen.update(x) or {"text_embeds": np.array([[3.0, 4.0]])})
    assert seen["text"] == "a photo of cat" and seen["input_ids"].shape == (1, 3)


def test_images():
    rgb = np.arange(6 * 8 * 3, dtype=np.uint8).reshape(6, 8, 3)
    assert inference.model_image(rgb, 4).shape == inference.model_image(rgb, 4, "squash").shape == (4, 4, 3)
    t = fc.image_tensor(rgb, bgr=True)
    assert t.shape == (3, 6, 8) and t[0, 0, 0] == pytest.approx((2 / 255 - 0.5) / 0.5)
    canvas, w, h = inference.detection_canvas(rgb, 16)
    assert (w, h) == (16, 12) and canvas[12:].sum() == 0
    assert inference.encode_image(rgb, CONFIG, lambda x: {"image_embeds": np.array([[x["pixel_values"].shape[2], 0.0]])}).tolist() == [1, 0]


def test_alignment_undoes_a_shift():
    y, x = np.mgrid[:200, :200]
    rgb = np.stack([x, y, (x + y) // 2], -1).astype(np.uint8)
    marks = (np.array(fc.TEMPLATE).reshape(-1, 2) + [30, 20]) / 200
    crop, t = inference.align_face(rgb, marks.ravel())
    assert fc.similarity_scale(t) == pytest.approx(1, abs=1e-3)
    assert np.abs(crop[5:100, 5:100].astype(int) - rgb[25:120, 35:130].astype(int)).max() <= 2


def test_analysis_of_a_picture():
    rgb = np.random.default_rng(1).integers(0, 255, (128, 128, 3)).astype(np.uint8)

    def levels(canvas):
        cls = np.zeros(16)
        cls[5] = 1.0
        kps = np.zeros((16, 5, 2))
        kps[5] = np.array(fc.TEMPLATE).reshape(5, 2) / 112
        return [(cls, cls, np.zeros(64), kps.ravel(), 32, 4)]

    got = inference.analyze_faces(rgb, 128, levels, lambda x: {"out": np.array([[1.0, 1.0]])}, 2)
    assert len(got) == 1 and got[0]["embedding"] == pytest.approx([0.5**0.5] * 2) and 0 <= got[0]["quality"] <= 1
    assert inference.analyze_faces(rgb, 128, lambda c: [], None) == []


def test_translation():
    words = {2: "hello", 3: "world"}
    calls = []

    def step(state, ids):
        calls.append(1)
        out = np.zeros(5)
        out[{1: 2, 2: 3}.get(len(ids), 1)] = 1
        return out

    t = inference.Translator(CONFIG, ["fr"], "en", lambda s: np.zeros(1), step, lambda ids: " ".join(words[i] for i in ids))
    assert t.translate("bonjour", "FR") == "hello world" and len(calls) == 3
    assert t.translate("bonjour", "fr") == "hello world" and len(calls) == 3
    assert t.translate("hallo", "de") is None and t.translate("x", "fr", ["es"]) is None
    t.step = lambda *_: 1 / 0
    assert t.translate("new", "fr") is None


def test_vocabulary_files():
    assert tk.parse_vocab_json('{"a": 1}') == {"a": 1}
    model = '{"model": {"vocab": {"a": 0, "b": 1}, "merges": ["a b", ["b", "a"], "bad"]}}'
    assert tk.parse_model_json(model) == ({"a": 0, "b": 1}, {("a", "b"): 0, ("b", "a"): 1})
    assert tk.parse_unigram_json('{"model": {"unk_id": 1, "vocab": [["a", -1.5], ["<unk>", 0]]}}') == ([("a", -1.5), ("<unk>", 0.0)], 1)


def test_session_and_scans(spark):
    s = actions.Session()
    s.skipped.add(("face", 1))
    assert s.remaining(3) == 2 and s.remaining(0) == 0
    scans = actions.Scans()
    assert scans.start("full") and not scans.start("gallery") and scans.start("full")
    scans.cancel()
    assert scans.cancelled and scans.start("gallery")
    m = spark.createDataFrame([(1, "clip", True), (2, "clip", False), (3, "ocr", False)], "id long, model_type string, is_active boolean")
    assert [activation(m, k)[0] for k in (1, 2, 3, 9)] == ["none", "confirm", "activate", "none"]


def test_storage(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x").write_bytes(b"12345")
    assert storage_sizes(str(tmp_path)) == 5 and storage_sizes(str(tmp_path / "none")) == 0
