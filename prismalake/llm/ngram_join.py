"""N-gram Jaccard self-join with count vectors in R-trees.

A document is the set of its distinct word shingles; two documents link when
4 * |A and B| >= 3 * |A or B|, that is 7 * |A and B| >= 3 * (|A| + |B|). The
shingles of a set are hashed into groups and the group counts are a point; the
sum of the smaller coordinates of two points bounds the overlap of their sets
from above, and the same sum against the corner of an R-tree node bounds it for
everything below the node. Pairs that survive are verified on the whole sets.

Which points meet in one tree:

* Documents with equal sets are one class (a hash of the set), so copies cost
  nothing beyond one row each.
* Sets are cut to the ``n - ceil(3n/4) + l`` smallest hashes, l = n // 8 + 1.
  Linked sets share at least l of these, so a class with fewer than l hashes that
  another class has too links with nothing, and each class may leave out the most
  frequent of its shared hashes as long as fewer than l are left out. What
  remains are the blocks: the classes that share a hash.
* Most links of a large group are found by a star: every class is verified
  against the best connected class of its blocks.
* Blocks that still hold several components and have the same first class form
  one group, so that a pair meets once however many hashes it shares. A group is
  dealt to tasks in units of bounded size (a group, or two tiles of a large one).
  A unit gets an R-tree, survivors are verified there on the whole sets, and only
  links that join two components of the unit leave it: fewer than it has rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, few, small_batches
from .components import components
from .shingles import WIDTH, mix, shingle_set

#: Groups of the R-tree's points, and of the finer ones that check a pair before its sets are fetched.
GROUPS, FINE_GROUPS = 256, 512
#: Neighbouring groups are added up to this many for the nodes of a tree and for a first look at a point.
COARSE = 32
#: One group count takes a byte; a full byte means "this or more" and bounds nothing.
FULL = 255
#: Points of an R-tree leaf, children of a node.
LEAF, FANOUT = 16, 8
#: Hashes of the sets in a tile of a large group, and what a row of its own counts besides.
TILE, ROW_WEIGHT = 1 << 21, 512
#: Rows (16 bytes each) of one partition while shared hashes are sorted out; also the most that a hash's number of classes is counted to.
PARTITION_ROWS = 1_000_000
#: Hashes looked at to find those that would fill a partition alone.
SAMPLE_HASHES = 200_000
#: Ids up to which the set-bearing rows are found by a broadcast; beyond, by a shuffle.
MAX_BROADCAST = 1_000_000


def slack(n):
    """Shared hashes beyond the first that a prefix of a set of n must show."""
    return n // 8 + 1


def prefix_length(n: int) -> int:
    return min(n, n - -(-3 * n // 4) + slack(n))


def linked(size_a, size_b, overlap):
    """Whether sets of these sizes and this overlap link."""
    return 7 * overlap >= 3 * (size_a + size_b)


def set_id(s: np.ndarray) -> int:
    """A 64-bit id of a set (sets with equal ids are taken as equal)."""
    total, odd = s.sum(dtype=np.uint64), np.bitwise_xor.reduce(s)
    return int(mix(mix(np.array([total], np.uint64) + np.uint64(len(s))) ^ odd).view(np.int64)[0])


def point(s: np.ndarray, groups: int) -> np.ndarray:
    """Counts of the set's hashes by group, clipped to a byte."""
    return np.minimum(np.bincount(((s >> np.uint64(24)) % np.uint64(groups)).astype(np.int64), minlength=groups), FULL).astype(np.uint8)


def bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Upper bound of the overlap: summed coordinate minima; where both are full nothing is known."""
    low = np.minimum(a, b).astype(np.int64)
    return np.where((low == FULL).any(-1), np.iinfo(np.int64).max // 8, low.sum(-1))


def coarse(points: np.ndarray) -> np.ndarray:
    """Points of COARSE groups: sums of neighbouring coordinates; a full byte makes its sum full."""
    parts = points.reshape(len(points), COARSE, -1)
    return np.where((parts == FULL).any(-1), 1 << 30, parts.sum(-1, dtype=np.int32)).astype(np.int32)


def coarse_bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum(a, b).sum(-1, dtype=np.int64)


class RTree:
    """Points packed by size and by their most varied coordinate; a node keeps its corner and its sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        rough = coarse(points)
        order = np.lexsort((rough[:, int(rough.var(0).argmax())], sizes))
        self.points, self.rough, self.sizes, self.order = points[order], rough[order], sizes[order].astype(np.int64), order
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        corner, small, big, step = self.rough, self.sizes, self.sizes, LEAF
        while len(corner) > 1 or not self.levels:
            at = np.arange(0, len(corner), step)
            corner, small, big = np.maximum.reduceat(corner, at), np.minimum.reduceat(small, at), np.maximum.reduceat(big, at)
            self.levels.append((corner, small, big))
            step = FANOUT

    def near(self, k: int, open_: np.ndarray) -> np.ndarray:
        """Places behind k, among the ``open_`` ones, whose point may belong to a set linked with that at k."""
        p, n = self.rough[k], self.sizes[k]
        nodes = np.array([0])
        for depth in range(len(self.levels) - 1, -1, -1):
            corner, small, big = self.levels[depth]
            ok = (4 * big[nodes] >= 3 * n) & (3 * small[nodes] <= 4 * n) & (7 * coarse_bound(corner[nodes], p) >= 3 * (small[nodes] + n))
            nodes = nodes[ok]
            if not len(nodes):
                return nodes
            width, most = (LEAF, len(self.points)) if depth == 0 else (FANOUT, len(self.levels[depth - 1][0]))
            nodes = (nodes[:, None] * width + np.arange(width)).ravel()
            nodes = nodes[nodes < most]
        nodes = nodes[(nodes > k) & open_[nodes]]
        nodes = nodes[7 * coarse_bound(self.rough[nodes], p) >= 3 * (self.sizes[nodes] + n)]
        return nodes[7 * bound(self.points[nodes], self.points[k]) >= 3 * (self.sizes[nodes] + n)]


def unit_links(side: np.ndarray, comps: np.ndarray, sets: list[np.ndarray], every: bool = False) -> list[tuple[int, int]]:
    """Links between different components of a unit, as places; none joins what others have joined already, unless ``every`` link is asked for.

    Points of one side only meet each other; of two sides only the other one's.
    Survivors of the tree are verified on the whole sets by the places at which
    their hashes occur in the unit.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    tree = RTree(np.stack([point(s, GROUPS) for s in sets]), sizes)
    order, sizes = tree.order, tree.sizes
    side, group = side[order], np.unique(comps[order], return_inverse=True)[1]
    crossed = bool(side.any())
    _, hashes = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)
    edge = np.concatenate(([0], np.cumsum(sizes)))
    owner = np.repeat(np.arange(len(sizes)), sizes)[np.argsort(hashes, kind="stable")]
    held = np.bincount(hashes)
    begin = np.cumsum(held) - held
    found: list[tuple[int, int]] = []
    for k in range(len(sizes) - 1):
        near = tree.near(k, (group != group[k]) & ((side != side[k]) | (not crossed)))
        if not len(near):
            continue
        own = hashes[edge[k] : edge[k + 1]]
        own = own[held[own] > 1]
        n = held[own]
        at = np.repeat(begin[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        near = near[linked(sizes[near], sizes[k], np.bincount(owner[at], minlength=len(sizes))[near])]
        if every:
            found += [(int(order[k]), int(order[j])) for j in near]
            continue
        joined, first = np.unique(group[near], return_index=True)
        found += [(int(order[k]), int(order[j])) for j in near[first]]
        group[np.isin(group, joined)] = group[k]
    return found


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    texts = batch.column("text")
    for i in range(batch.num_rows):
        yield i, shingle_set(texts[i].as_py(), width)


def classes(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, text_key, n_shingles, cls) of every row; cls is null for empty sets."""
    kind = docs.select("doc_id").schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in batches:
                got = [(len(s), set_id(s) if len(s) else None) for _, s in _sets(b, width)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array([n for n, _ in got], pa.int64()), pa.array([c for _, c in got], pa.int64())], names=["doc_id", "text_key", "n_shingles", "cls"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, f"doc_id {kind}, text_key long, n_shingles long, cls long")


def prefixes(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(token, cls) for the hashes in the prefix of each set; a task emits a set once, however many copies it reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        with np.errstate(over="ignore"):
            for b in batches:
                tokens, owners = [], []
                for _, s in _sets(b, width):
                    if len(s) and (c := set_id(s)) not in done:
                        done.add(c)
                        p = s[: prefix_length(len(s))].view(np.int64)
                        tokens.append(p)
                        owners.append(np.full(len(p), c, np.int64))
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.concatenate(owners))], names=["token", "cls"])

    return docs.mapInArrow(run, "token long, cls long")


def frequent_tokens(docs: DataFrame, expected: int, parts: int, width: int = WIDTH) -> list[int]:
    """Tokens that would fill one of ``parts`` partitions alone, by a sample of about SAMPLE_HASHES of ``expected`` hashes; about ``parts`` at most.

    They decide how rows are dealt and which tokens count as the most frequent, not what is found.
    """
    share = max(1, expected // SAMPLE_HASHES)
    seen = prefixes(docs.filter(F.pmod(F.xxhash64("text"), F.lit(share)) == 0), width).groupBy("token").count()
    return sorted(r.token for r in seen.filter((F.col("count") > 100) & (F.col("count") * parts * share > expected)).select("token").collect())


def shared_tokens(tokens: DataFrame, rows: int, frequent: list[int]) -> DataFrame:
    """(token, cls, df) of the tokens that several classes have, df counted up to PARTITION_ROWS.

    Rows stream through sorted, so a task holds at most PARTITION_ROWS of a
    token, and ``frequent`` tokens, whose df counts as PARTITION_ROWS, are dealt
    by class. ``rows`` (how many there will be) sets the number of partitions.
    """
    parts = token_partitions(tokens, rows)
    hot = np.array(frequent, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(token: np.ndarray, cls: np.ndarray, df: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(token), pa.array(cls), pa.array(df)], names=["token", "cls", "df"])

        none = np.empty(0, np.int64)
        open_t, open_c, last, full = none, none, None, False  # the last token's rows, its last row, whether it has been passed on already
        for b in batches:
            if not b.num_rows:
                continue
            token, cls = b.column(0).to_numpy(), b.column(1).to_numpy()
            fresh = np.ones(len(token), bool)
            fresh[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])
            fresh[0] = last != (token[0], cls[0])
            same = last is not None and token[0] == last[0]
            last = (token[-1], cls[-1])
            token, cls = token[fresh], cls[fresh]
            if full and same:
                more = int(np.searchsorted(token, token[0], "right")) if len(token) and token[0] == open_t[0] else 0
                if more:
                    yield out(token[:more], cls[:more], np.full(more, PARTITION_ROWS))
                    token, cls = token[more:], cls[more:]
                if not len(token):
                    continue
            if full:
                open_t, open_c, full = none, none, False
            token, cls = np.concatenate([open_t, token]), np.concatenate([open_c, cls])
            start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
            df = np.diff(np.append(start, len(token)))
            whole = int(start[-1])
            df = np.repeat(df, df)[:whole]
            keep = (df > 1) | np.isin(token[:whole], hot)
            if keep.any():
                df = np.where(np.isin(token[:whole], hot), PARTITION_ROWS, np.minimum(df, PARTITION_ROWS))
                yield out(token[:whole][keep], cls[:whole][keep], df[keep])
            open_t, open_c = token[whole:], cls[whole:]
            if len(open_t) >= PARTITION_ROWS or open_t[0] in hot:
                yield out(open_t, open_c, np.full(len(open_t), PARTITION_ROWS))
                open_t, open_c, full = open_t[:1], open_c[:1], True
        if not full and len(open_t) > 1:
            yield out(open_t, open_c, np.full(len(open_t), min(len(open_t), PARTITION_ROWS)))

    key = F.when(F.col("token").isin(frequent), F.xxhash64("token", "cls")).otherwise(F.col("token")) if frequent else F.col("token")
    return tokens.repartition(parts, key).sortWithinPartitions("token", "cls").mapInArrow(run, "token long, cls long, df long")


def token_partitions(df: DataFrame, rows: int) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // PARTITION_ROWS))


def bearers(docs: DataFrame, kept: DataFrame, width: int = WIDTH) -> DataFrame:
    """(cls, n, fine, hashes) of the kept classes, read from the id and text that represent each."""
    ids = few(kept.select(F.col("rep.doc_id").alias("__id"), F.col("rep.text_key").alias("__key")), MAX_BROADCAST)
    rows = docs.join(ids, docs["doc_id"].eqNullSafe(ids["__id"]) & (F.xxhash64(docs["text"]) == ids["__key"]), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        with np.errstate(over="ignore"):
            for b in batches:
                s = {set_id(x): x for _, x in _sets(b, width) if len(x)}
                s = {c: x for c, x in s.items() if c not in done}
                done.update(s)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(s), pa.int64()), pa.array([len(x) for x in s.values()], pa.int64())]
                    + [pa.array([f(x) for x in s.values()], pa.binary()) for f in (lambda x: point(x, FINE_GROUPS).tobytes(), lambda x: x.tobytes())],
                    names=["cls", "n", "fine", "hashes"],
                )

    sets = cut(rows.mapInArrow(run, "cls long, n long, fine binary, hashes binary"))
    # rows that repeat an id and its text may have come from several tasks
    return sets if sets.count() == kept.count() else cut(sets.dropDuplicates(["cls"]))


def _side(sets: DataFrame, side: str, *columns: str) -> DataFrame:
    return sets.select(F.col("cls").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that link: first by the fine points, then on the whole sets."""

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                a, c = (np.frombuffer(b"".join(b.column(x).to_pylist()), np.uint8).reshape(-1, FINE_GROUPS) for x in ("fine_a", "fine_b"))
                n = b.column("n_a").to_numpy() + b.column("n_b").to_numpy()
                keep = pa.array(7 * bound(a, c) >= 3 * n)
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(keep)

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("hashes_a").to_pylist(), b.column("hashes_b").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                keep.append(linked(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(_side(sets, "a", "n", "fine"), "a").join(_side(sets, "b", "n", "fine"), "b")
    left = both.mapInArrow(close, "a long, b long").distinct()
    whole = left.join(_side(sets, "a", "hashes"), "a").join(_side(sets, "b", "hashes"), "b")
    return whole.mapInArrow(same, "a long, b long").distinct()


def size_class(n: str) -> Column:
    """Sizes that can link are in one class or in neighbouring ones."""
    return F.floor(F.log(F.col(n).cast("double")) / F.log(F.lit(4 / 3)) + 1e-9).cast("long")


def groups(live: DataFrame, comps: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lead, cls, comp, n): the classes of the blocks whose first class is ``lead`` and which hold several components."""
    labelled = live.join(comps.withColumnRenamed("v", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    mixed = labelled.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("cls").alias("lead")).filter("lo <> hi")
    members = labelled.join(mixed.select("token", "lead"), "token").select("lead", "cls", "comp").distinct()
    return members.join(sizes.select("cls", "n"), "cls")


def units(members: DataFrame) -> DataFrame:
    """(unit, side, cls, comp, n): the classes that meet in a task.

    A group of up to TILE is a unit of one side. A larger one is cut into tiles
    by size class, by hash, and by component where one alone fills a tile; a
    unit is a tile, or two whose sets may link, one a side. Two tiles of the
    same component never meet, so a group that the star has joined costs its
    rows times the tiles of what is left.
    """
    weight = F.col("n") + ROW_WEIGHT
    big = few(members.groupBy("lead").agg(F.sum(weight).alias("w")).filter(F.col("w") > TILE).select("lead"))
    one = F.lit(0).alias("side")
    small = members.join(big, "lead", "left_anti").select(F.col("lead").cast("string").alias("unit"), one, "cls", "comp", "n")
    if not big.limit(1).count():
        return small
    rows = members.join(big, "lead").withColumn("k", size_class("n"))
    heavy = rows.groupBy("lead", "k", "comp").agg(F.sum(weight).alias("w")).filter(F.col("w") > TILE).select("lead", "k", "comp", F.lit(True).alias("heavy"))
    rows = rows.join(heavy, ["lead", "k", "comp"], "left").withColumn("of", F.when(F.col("heavy"), F.col("comp").cast("string")).otherwise(""))
    stock = rows.groupBy("lead", "k", "of").agg(F.ceil(F.sum(weight) / TILE).cast("long").alias("tiles"))
    rows = cut(rows.join(stock, ["lead", "k", "of"]).withColumn("tile", F.pmod(F.xxhash64("cls"), F.col("tiles"))))
    tiles = cut(rows.select("lead", "k", "of", "tile").distinct())
    place = F.struct("k", "of", "tile")
    left = tiles.select("lead", place.alias("a"))
    right = tiles.select(F.col("lead").alias("lead_b"), place.alias("b"))
    near = (F.col("a.k") == F.col("b.k")) & (F.col("a") <= F.col("b")) | (F.col("a.k") + 1 == F.col("b.k"))
    apart = (F.col("a.of") == "") | (F.col("a.of") != F.col("b.of"))
    met = left.join(right, (F.col("lead") == F.col("lead_b")) & near & apart)
    met = met.select("lead", "a", "b", F.concat_ws("/", *(F.col(c).cast("string") for c in ("lead", "a.k", "a.of", "a.tile", "b.k", "b.of", "b.tile"))).alias("unit"))
    first = met.select("lead", "a.*", "unit", one)
    second = met.filter("a <> b").select("lead", "b.*", "unit", F.lit(1).alias("side"))
    dealt = rows.join(first.union(second), ["lead", "k", "of", "tile"])
    return small.unionByName(dealt.select("unit", "side", "cls", "comp", "n"))


def tree_links(members: DataFrame, sets: DataFrame, every: bool = False) -> DataFrame:
    """Links (a, b) between components that the R-trees of the units find, verified on the whole sets; see ``unit_links``."""
    work = cut(units(members))
    held = work.agg(F.sum(F.col("n") + ROW_WEIGHT)).first()[0] or 0
    parts = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-held // TILE))
    dealt = work.drop("n").join(sets.select("cls", "hashes"), "cls").repartition(parts, "unit").sortWithinPartitions("unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(rows: list[tuple]) -> list[tuple[int, int]]:
            side, ids, comps = (np.array([r[k] for r in rows], np.int64) for k in range(3))
            return [(ids[x], ids[y]) for x, y in unit_links(side, comps, [np.frombuffer(r[3], np.uint64) for r in rows], every)]

        unit, rows, found = None, [], []
        for b in batches:
            for u, *row in zip(*(b.column(c).to_pylist() for c in ("unit", "side", "cls", "comp", "hashes")), strict=True):
                if u != unit:
                    if rows:
                        found += links(rows)
                    unit, rows = u, []
                rows.append(row)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])
                found = []
        if rows and (found := links(rows)):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _place() -> Column:
    """Where a row ranks among those of its class or component."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")


@dataclass
class Candidates:
    """What may link: rows of ``classes``; a row a class (n, rep); those that share enough hashes (``kept``), their blocks and sets."""

    rows: DataFrame
    known: DataFrame
    kept: DataFrame
    live: DataFrame
    sets: DataFrame


def candidates(docs: DataFrame, width: int = WIDTH) -> Candidates:
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = cut(classes(docs, width))
    known = cut(rows.filter("cls is not null").groupBy("cls").agg(F.first("n_shingles").alias("n"), F.min(_place()).alias("rep")))

    # a prefix is at most 3/8 of its set and 2 more
    expected = known.agg(F.sum(F.expr("3 * n div 8 + 2"))).first()[0] or 0
    frequent = frequent_tokens(docs, expected, token_partitions(docs, expected), width)
    shared = cut(shared_tokens(prefixes(docs, width), expected, frequent))
    weight = shared.groupBy("cls").agg(F.count("*").alias("shared"), F.sum(F.log(F.col("df").cast("double"))).alias("w"))
    kept = cut(known.join(weight, "cls").filter(F.col("shared") >= F.expr("n div 8 + 1")).select("cls", "n", "rep", F.round(F.col("w") / F.col("n"), 9).alias("z")))
    # a partner may be a quarter smaller and so show fewer hashes: only as many may be left out as its slack allows
    spare = F.expr("(3 * n + 3) div 4 div 8")
    rank = F.row_number().over(W.partitionBy("cls").orderBy(F.desc("df"), "token"))
    live = shared.join(kept.select("cls", "n", "z"), "cls").withColumn("rank", rank).filter(F.col("rank") > spare)
    live = cut(live.select("token", "cls", "z"))
    return Candidates(rows, known, kept, live, bearers(docs, kept, width))


def linked_classes(docs: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """The rows of ``classes``, and (cls, comp, component_id) of every class: comp tells components apart, component_id is the smallest id."""
    c = candidates(docs, width)
    known, kept, live, sets = c.known, c.kept, c.live, c.sets
    hub = live.groupBy("token").agg(F.max(F.struct("z", "cls")).alias("hub"), F.count("*").alias("m")).filter("m > 1").select("token", F.col("hub.cls").alias("b"))
    star = live.join(hub, "token").filter("cls <> b").groupBy("cls", "b").agg(F.count("*").alias("m"))
    star = star.groupBy(F.col("cls").alias("a")).agg(F.max(F.struct("m", "b")).alias("best")).select("a", "best.b")
    first = cut(verified(star, sets))
    inside = components(first)
    rest = cut(tree_links(cut(groups(live.select("token", "cls"), inside, kept)), sets))
    comps = components(first.union(rest))

    named = known.join(comps.withColumnRenamed("v", "cls"), "cls", "left").select("cls", "rep", F.coalesce("comp", "cls").alias("comp"))
    smallest = named.groupBy("comp").agg(F.min("rep.doc_id").alias("component_id"))
    return c.rows, named.join(smallest, "comp").select("cls", "comp", "component_id")


def links(docs: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """Every link: the rows of ``classes``, which tell who belongs to a class, and the pairs (a, b) of linked classes, a < b.

    Pairs are as many as there are links between different sets, so of a group of
    m near copies up to m * m / 2; ``join`` needs fewer.
    """
    c = candidates(docs, width)
    alone = c.live.sparkSession.createDataFrame([], "v long, comp long")
    found = tree_links(cut(groups(c.live.select("token", "cls"), alone, c.kept)), c.sets, every=True)
    return c.rows, found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def link_counts(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_links) of every row: the other rows that it links with, equal sets included; see ``join`` for odd rows."""
    rows, pairs = links(docs, width)
    size = cut(rows.filter("cls is not null").groupBy("cls").agg(F.count("*").alias("size")))
    both = pairs.union(pairs.select("b", "a"))
    other = both.join(size.withColumnRenamed("cls", "b"), "b").groupBy(F.col("a").alias("cls")).agg(F.sum("size").alias("other"))
    counts = size.join(other, "cls", "left").select("cls", (F.col("size") - 1 + F.coalesce("other", F.lit(0))).alias("n"))
    return rows.join(counts, "cls", "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"))


def join(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest doc_id that links reach).

    Null, empty and wordless texts have 0 shingles and link with nothing; their
    component is their own id. Very long texts are taken whole. Repeated rows are
    equal sets, ties don't matter (every link counts), an empty table gives no
    rows. A null doc_id keeps its row; it names a component only where no other
    id does (then null). Other columns, whatever their names, are ignored.
    """
    rows, by_class = linked_classes(docs, width)
    return rows.join(by_class, "cls", "left").select(
        "doc_id", "n_shingles", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def contract(docs: DataFrame) -> DataFrame:
    """The rows of ``join``, whose docstring defines nulls, empty and long texts, ties, repeats, empty tables and further columns."""
    return join(docs)


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents, all columns, one of each group: the row with the smallest id (null last; of its texts that with the smallest hash).

    A document is an id with a text: another text of the same id is judged by
    its own links. Rows that repeat both are one document. Null, empty and
    wordless texts link with nothing and stay, once an id. Very long texts are
    compared whole; an empty table stays empty; columns keep their names.
    """
    rows, by_class = linked_classes(docs)
    known = cut(rows.join(by_class.select("cls", "comp"), "cls", "left"))
    first = known.filter("cls is not null").groupBy(F.col("comp").alias("of")).agg(F.min(_place()).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    gone = known.join(first, F.col("comp") == F.col("of")).filter(_place() != F.col("first")).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    again = known.groupBy("doc_id", "text_key").count().filter("count > 1").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
    key = F.xxhash64(docs["text"].cast("string"))
    same = lambda t: docs["doc_id"].eqNullSafe(t["__id"]) & (key == t["__key"])
    gone, again = few(gone), few(again)
    kept = docs.join(gone, same(gone), "left_anti")
    if not again.limit(1).count():
        return kept
    twice = kept.join(again, same(again), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, same(again), "left_anti").unionByName(twice)
