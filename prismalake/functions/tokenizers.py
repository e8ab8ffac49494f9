"""Tokenizers: merge-ranked BPE in two dialects and a unigram model; all take their vocabulary as data."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import functions as F

SPACE = "▁"


def byte_alphabet() -> dict[int, str]:
    """A printable character for each byte: printable Latin-1 stands for itself, the rest follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def merge_pairs(pieces: Sequence[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Join the best ranked neighbouring pair, everywhere it stands, until none has a rank."""
    out = list(pieces)
    while len(out) > 1:
        best = min(zip(out, out[1:], strict=False), key=lambda p: ranks.get(p, 1 << 60))
        if best not in ranks:
            break
        joined, k = [], 0
        while k < len(out):
            if k + 1 < len(out) and (out[k], out[k + 1]) == best:
                joined.append(out[k] + out[k + 1])
                k += 2
            else:
                joined.append(out[k])
                k += 1
        out = joined
    return out


def parse_merges(lines: Iterable[str | Sequence[str]]) -> dict[tuple[str, str], int]:
    """Ranks of merges given as ``"a b"`` or pairs; comment lines and malformed ones don't count."""
    pairs = (tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in lines if not (isinstance(x, str) and x.startswith("#")))
    return {p: k for k, p in enumerate(p for p in pairs if len(p) == 2 and all(p))}


def parse_vocab_json(text: str) -> dict[str, int]:
    return {str(k): int(v) for k, v in json.loads(text).items()}


def parse_model_json(text: str) -> tuple[dict[str, int], dict[tuple[str, str], int]]:
    """Vocabulary and merges of a tokenizer file with a BPE model."""
    model = json.loads(text)["model"]
    return {k: int(v) for k, v in model["vocab"].items()}, parse_merges(model["merges"])


def parse_unigram_json(text: str) -> tuple[list[tuple[str, float]], int]:
    """Pieces with log probabilities and the unknown piece's id."""
    model = json.loads(text)["model"]
    return [(str(p), float(s)) for p, s in model["vocab"]], int(model.get("unk_id") or 0)


@dataclass
class ClipBpe:
    """Lower-cased words in bytes with word ends, padded to ``context``."""

    vocab: dict[str, int]
    merges: dict[tuple[str, str], int]
    context: int = 77
    start: str = "<|startoftext|>"
    end: str = "<|endoftext|>"
    pad: int = 0
    WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+", re.I)

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """Ids and mask of exactly ``context`` places; an overlong text keeps its end mark."""
        alphabet, ids = byte_alphabet(), [self.vocab[self.start]]
        for word in self.WORDS.findall(" ".join(text.split()).lower()):
            chars = [alphabet[b] for b in word.encode()]
            chars[-1] += "</w>"
            ids += [self.vocab[p] for p in merge_pairs(chars, self.merges) if p in self.vocab]
        ids = [*ids, self.vocab[self.end]]
        if len(ids) > self.context:
            ids = [*ids[: self.context - 1], self.vocab[self.end]]
        mask = [1] * len(ids) + [0] * (self.context - len(ids))
        return ids + [self.pad] * (self.context - len(ids)), mask


@dataclass
class SentencePieceBpe:
    """Merges over the whole text, spaces as marks, unknown characters as bytes; the mask is all ones."""

    vocab: dict[str, int]
    merges: dict[tuple[str, str], int]
    context: int = 64
    end: str = "<eos>"
    pad: str = "<pad>"
    unk: str = "<unk>"

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        ids: list[int] = []
        for p in merge_pairs(list(text.replace(" ", SPACE)), self.merges):
            if p in self.vocab:
                ids.append(self.vocab[p])
            else:
                parts = (f"<0x{b:02X}>" for b in p.encode())
                ids += [i for x in parts if (i := self.vocab.get(x, self.vocab.get(self.unk))) is not None]
        ids = [*ids[: self.context - 1], self.vocab[self.end]]
        return ids + [self.vocab.get(self.pad, 0)] * (self.context - len(ids)), [1] * self.context


@dataclass
class Unigram:
    """Best segmentation by summed log probabilities; an unknown character costs the minimum less ten."""

    pieces: list[tuple[str, float]]
    unk: int = 0
    end: int | None = None

    def __post_init__(self) -> None:
        self.score = {p: (s, k) for k, (p, s) in reversed(list(enumerate(self.pieces)))}
        self.longest = max(map(len, self.score), default=1)
        self.unknown = min((s for _, s in self.pieces), default=0.0) - 10

    def encode(self, text: str) -> list[int]:
        t = SPACE + unicodedata.normalize("NFKC", text).replace(" ", SPACE)
        best: list[tuple[float, int, int]] = [(0.0, 0, 0)]
        for end in range(1, len(t) + 1):
            top = None
            for start in range(max(0, end - self.longest), end):
                hit = self.score.get(t[start:end])
                if hit is None and end - start > 1:
                    continue
                s, k = hit or (self.unknown, self.unk)
                if top is None or best[start][0] + s > top[0]:
                    top = (best[start][0] + s, start, k)
            best.append(top)
        ids, at = [], len(t)
        while at:
            _, at, k = best[at]
            ids.append(k)
        return ids[::-1] + ([] if self.end is None else [self.end])

    def decode(self, ids: Iterable[int], skip: Iterable[int] = ()) -> str:
        gone = set(skip)
        return "".join(self.pieces[i][0] for i in ids if i not in gone and 0 <= i < len(self.pieces)).replace(SPACE, " ").strip()


def encode_column(tokenizer):
    """ids of each text as an Arrow UDF; the tokenizer travels with the function."""

    @F.pandas_udf("array<int>")
    def run(s):
        def one(t):
            got = tokenizer.encode(t)
            return got[0] if isinstance(got, tuple) else got

        return s.map(one, na_action="ignore")

    return run
