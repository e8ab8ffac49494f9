"""Assignment of newly found faces, photo by photo.

A photo's assignments move the centroids that the next photo is compared with,
so the exact result depends on the order and is computed in one pass over the
photos by id. ``people.assign_faces`` compares with frozen centroids instead,
scales, and may differ.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.people import AUTO, PENDING, QUALITY


@dataclass
class State:
    """Weighted sums of the committed vectors of each person."""

    sums: dict[int, np.ndarray] = field(default_factory=dict)
    named: set[int] = field(default_factory=set)
    fixed: dict[int, np.ndarray] = field(default_factory=dict)  # centroids without vectors behind them

    def centroid(self, p: int) -> np.ndarray:
        s = self.sums.get(p)
        if s is None:
            return self.fixed[p]
        n = np.linalg.norm(s)
        return s / n if n else s

    def people(self) -> list[int]:
        return sorted(set(self.sums) | set(self.fixed))


def assign_photo(state: State, faces: list[dict], manual: bool = False, high: float = AUTO, medium: float = PENDING, floor: float = QUALITY, next_id: int = 1) -> tuple[list[dict], int]:
    """Outcomes of one photo's faces in detection order; a person is found once a photo at most.

    Each face has embedding, quality, weight. Centroids move after the photo.
    """
    out, taken, moves = [], set(), []
    centroids = {p: state.centroid(p) for p in state.people()}
    for f in faces:
        v = np.asarray(f["embedding"], float)
        if f["quality"] < floor:
            out.append({"assignment_type": "ignored", "exclusion_reason": "low_quality", "person_id": None, "similarity": None})
            continue
        if manual:
            out.append({"assignment_type": "pending", "exclusion_reason": None, "person_id": None, "similarity": None})
            continue
        best, sim = None, -np.inf
        for p, c in centroids.items():
            if p not in taken and len(c) == len(v) and float(c @ v) > sim:
                best, sim = p, float(c @ v)
        known = None if best is None else sim
        if best is not None and sim >= high:
            taken.add(best)
            moves.append((best, f["weight"] * v))
            out.append({"assignment_type": "auto", "exclusion_reason": None, "person_id": best, "similarity": known})
        elif best is not None and sim >= medium and best in state.named:
            taken.add(best)
            out.append({"assignment_type": "pending", "exclusion_reason": None, "person_id": best, "similarity": known})
        else:
            taken.add(next_id)
            moves.append((next_id, f["weight"] * v))
            out.append({"assignment_type": "auto", "exclusion_reason": None, "person_id": next_id, "similarity": known})
            next_id += 1
    for p, v in moves:
        state.sums[p] = state.sums[p] + v if p in state.sums else v
    return out, next_id


#: Faces whose products with all centroids are taken at once, and the most bytes of those products.
BLOCK, BLOCK_BYTES = 256, 32 << 20


class _Side:
    """Centroids of one dimension as rows of a matrix.

    A block of faces meets the rows in one product; rows that change after that
    (``fresh``) meet each later face of the block on their own.
    """

    def __init__(self, dim: int) -> None:
        self.rows, self.ids, self.blocked = np.empty((16, dim)), np.empty(16, np.int64), np.zeros(16, bool)
        self.at: dict[int, int] = {}
        self.top, self.sims, self.known = 0.0, np.empty((0, 0)), 0
        self.fresh, self.fresh_rows, self.fresh_at = np.empty((16, dim)), np.empty(16, np.int64), {}

    def put(self, person: int, centroid: np.ndarray) -> None:
        row = self.at.setdefault(person, len(self.at))
        if row == len(self.rows):
            self.rows, self.ids, self.blocked = (np.concatenate([x, np.zeros_like(x)]) for x in (self.rows, self.ids, self.blocked))
        self.rows[row], self.ids[row] = centroid, person
        norm = float(np.linalg.norm(centroid))
        self.top = self.top if np.isnan(norm) else max(self.top, norm)
        k = self.fresh_at.setdefault(row, len(self.fresh_at))
        if k == len(self.fresh):
            self.fresh, self.fresh_rows = (np.concatenate([x, np.zeros_like(x)]) for x in (self.fresh, self.fresh_rows))
        self.fresh[k], self.fresh_rows[k] = centroid, row
        if row < self.known:
            self.sims[:, row] = -np.inf

    def begin(self, vectors: np.ndarray) -> None:
        self.known, self.fresh_at = len(self.at), {}
        self.sims = _numbers(vectors @ self.rows[: self.known].T)

    def best(self, k: int, v: np.ndarray) -> tuple[int | None, float]:
        """The most similar person that isn't blocked for the block's face ``k``, the smallest id on ties.

        Products find what may be best up to their rounding; among those the dot product decides.
        """
        n = len(self.at)
        margin = 8 * np.finfo(float).eps * (len(v) + 1) * self.top * float(np.linalg.norm(v))
        if np.isfinite(margin):
            old, new = self.sims[k], _numbers(self.fresh[: len(self.fresh_at)] @ v)
            fresh = self.fresh_rows[: len(new)]
            old[self.blocked[: self.known]] = -np.inf
            new[self.blocked[fresh]] = -np.inf
            most = max(old.max(initial=-np.inf), new.max(initial=-np.inf))
            if most == -np.inf:
                return None, -np.inf
            rows = np.concatenate([np.flatnonzero(old >= most - margin), fresh[new >= most - margin]])
        else:
            rows = np.flatnonzero(~self.blocked[:n])
        person, sim = None, -np.inf
        for row in rows[np.argsort(self.ids[rows])]:
            s = float(self.rows[row] @ v)
            if s > sim:
                person, sim = int(self.ids[row]), s
        return person, sim


def _numbers(x: np.ndarray) -> np.ndarray:
    x[np.isnan(x)] = -np.inf
    return x


class _Pass:
    """``assign_photo`` over faces in order, with the centroids in matrices; a photo may go on in the next block."""

    def __init__(self, state: State, manual: bool, next_id: int, high: float = AUTO, medium: float = PENDING, floor: float = QUALITY) -> None:
        self.state, self.manual, self.next_id, self.limits = state, manual, next_id, (high, medium, floor)
        self.sides: dict[int, _Side] = {}
        self.dims: dict[int, int] = {}
        self.photo, self.moves, self.taken = None, [], []
        for p in state.people():
            self._put(p)

    def _put(self, p: int) -> None:
        c = self.state.centroid(p)
        was = self.dims.get(p, len(c))
        if was != len(c):
            self.sides[was].put(p, np.full(was, np.nan))
        self.dims[p] = len(c)
        self.sides.setdefault(len(c), _Side(len(c))).put(p, c)

    def _take(self, p: int) -> None:
        side = self.sides.get(self.dims.get(p, -1))
        if side is not None:
            side.blocked[side.at[p]] = True
            self.taken.append((side, side.at[p]))

    def _turn(self, photo: int | None) -> None:
        """The photo before is done: its faces move the centroids."""
        for side, row in self.taken:
            side.blocked[row] = False
        for p, v in self.moves:
            self.state.sums[p] = self.state.sums[p] + v if p in self.state.sums else v
            self._put(p)
        self.photo, self.moves, self.taken = photo, [], []

    def size(self) -> int:
        return max(1, min(BLOCK, BLOCK_BYTES // (8 * max(1, len(self.dims)))))

    def block(self, b: pa.RecordBatch) -> pa.RecordBatch:
        high, medium, floor = self.limits
        quality, weight = (b.column(c).to_numpy(zero_copy_only=False) for c in ("quality", "weight"))
        vectors = b.column("embedding")
        size, place = np.array(pc.fill_null(pc.list_value_length(vectors), -1)), np.zeros(b.num_rows, int)
        matrices: dict[int, np.ndarray] = {}
        for d in np.unique(size[size >= 0]):
            at = np.flatnonzero(size == d)
            place[at] = np.arange(len(at))
            matrices[d] = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), d)
            if not self.manual:
                self.sides.setdefault(int(d), _Side(int(d))).begin(matrices[d])
        out = []
        for k, photo in enumerate(b.column("photo_id").to_pylist()):
            if photo is None or photo != self.photo:
                self._turn(photo)
            if quality[k] < floor:
                out.append((None, "ignored", "low_quality", None))
                continue
            if self.manual:
                out.append((None, "pending", None, None))
                continue
            if size[k] < 0:
                raise ValueError(f"face {b.column('id')[k]} has no embedding")
            v = matrices[size[k]][place[k]]
            best, sim = self.sides[size[k]].best(place[k], v)
            known = None if best is None else sim
            if best is not None and sim >= high:
                self._take(best)
                self.moves.append((best, weight[k] * v))
                out.append((best, "auto", None, known))
            elif best is not None and sim >= medium and best in self.state.named:
                self._take(best)
                out.append((best, "pending", None, known))
            else:
                self._take(self.next_id)
                self.moves.append((self.next_id, weight[k] * v))
                out.append((self.next_id, "auto", None, known))
                self.next_id += 1
        person, kind, reason, similarity = zip(*out, strict=True)
        kinds = (pa.int64(), pa.string(), pa.string(), pa.float64())
        made = [pa.array(x, t) for x, t in zip((person, kind, reason, similarity), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([b.column("id"), b.column("photo_id"), *made], names=["id", "photo_id", "person_id", "assignment_type", "exclusion_reason", "similarity"])


OUTCOME = "id long, photo_id long, person_id long, assignment_type string, exclusion_reason string, similarity double"


def assign_new_faces(faces: DataFrame, state: State, manual: bool = False, next_id: int = 1) -> DataFrame:
    """The exact pass over new faces (id, photo_id, embedding, quality, weight), photo by photo in one task.

    Each photo's assignments move the centroids, so the order is part of the
    result; faces stream through sorted, and only the centroids and one block's
    products are in memory. ``people.assign_faces`` is the one that scales.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        faces_of = _Pass(State(dict(state.sums), set(state.named), dict(state.fixed)), manual, next_id)
        for b in batches:
            k = 0
            while k < b.num_rows:
                part = b.slice(k, faces_of.size())
                k += part.num_rows
                yield faces_of.block(part)

    numbers = [F.col(c).cast("double").alias(c) for c in ("quality", "weight")]
    cols = faces.select(F.col("id").cast("long"), F.col("photo_id").cast("long"), "embedding", *numbers)
    return cols.repartition(1).sortWithinPartitions("photo_id", "id").mapInArrow(run, OUTCOME)
