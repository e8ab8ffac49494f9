"""Substring deduplication by hashed lines and sentences, and by word windows.

A text is cut into units: lines, and inside a line sentences, so that a passage
pasted into the middle of a line still shares whole units with its other
occurrences. A unit's digest ignores white space and the case of A-Z. Digests
are grouped over all documents; of equal units the earliest ranked (doc_id,
text, place) stays. Neighbouring units that have to go form a run, and runs of
at least ``MIN_WORDS`` words are removed; offsets are those of the original text.

Passages that begin or end inside units are found by windows of ``STRETCH``
words: a window with an earlier occurrence goes, wherever units begin. Of all
windows only those are compared whose fingerprint (the least hash of the
``GRAM`` words in them) occurs more than once; equal windows have equal
fingerprints, so that no repeat is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, small_batches
from .shingles import mix, word_hashes

#: Words that a removed run has at least; shorter repeats (a phrase, a licence line) stay.
MIN_WORDS = 40
#: Words of a window; of any repeated passage of as many words every word is removed.
STRETCH = 50
#: Words whose hashes are candidates for the fingerprint of a window.
GRAM = 25
#: Most bits (as a power of 2) of the filter of shared fingerprints; a fuller filter lets more windows through, never fewer.
FILTER_BITS = 27

_B = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(int(_B), -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BREAK = np.zeros(256, bool)
_BREAK[[0x0A, 0x0B, 0x0C, 0x0D]] = True
_STOP = np.zeros(256, bool)
_STOP[[0x21, 0x2E, 0x3F]] = True

_NAMES = ["digest", "doc_id", "key", "place", "span", "earlier"]
_SCHEMA = "digest long, doc_id long, key long, place long, span long, earlier long"
_EMPTY = np.iinfo(np.int64).max


def _rolling(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    np.multiply.accumulate(out, out=out)
    return out


def _word_edges(text: str) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 of a text, as bytes and as an array, and start and end (bytes) of each word."""
    raw = text.encode("utf-8", "surrogatepass")
    buf = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~_SPACE[buf]
    edge = np.flatnonzero(np.diff(inside))
    return raw, buf, edge[0::2], edge[1::2]


def _grams(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each ``k`` neighbouring words."""
    n = len(words)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(words * _rolling(_B, n)[:n], out=total[1:])
    return mix((total[k:] - total[:-k]) * _rolling(_INV, n)[: n - k + 1] + np.uint64(k))


def fingerprints(words: np.ndarray, stretch: int = STRETCH) -> np.ndarray:
    """The least hash of ``GRAM`` words in each window of ``stretch`` words."""
    if len(words) < stretch:
        return np.empty(0, np.uint64)
    least, n, have = _grams(words, GRAM), stretch - GRAM + 1, 1
    while have < n:
        step = min(have, n - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    return least


def units(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Digest, words, start and end (code points) of each unit of a text, in order.

    A unit begins at a line, after a word that ends in . ! or ?, and at a
    capitalised word behind one that isn't (A-Z and the capitals of Latin-1).
    """
    raw, buf, start, end = _word_edges(text)
    n = len(start)
    if not n:
        none = np.empty(0, np.int64)
        return none, none, none, none
    after = buf[np.minimum(start + 1, len(buf) - 1)]
    head = buf[start]
    capital = (head >= 65) & (head <= 90) | (head == 0xC3) & (after >= 0x80) & (after <= 0x9E)
    breaks = np.concatenate(([0], np.cumsum(_BREAK[buf])))
    first = np.ones(n, bool)
    first[1:] = (breaks[start[1:]] > breaks[end[:-1]]) | _STOP[buf[end[:-1] - 1]] | capital[1:] & ~capital[:-1]
    at = np.flatnonzero(first)
    to = np.append(at[1:], n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(word_hashes(text) * _rolling(_B, n)[:n], out=total[1:])
    digest = mix((total[to] - total[at]) * _rolling(_INV, n)[at] + (to - at).astype(np.uint64))
    a, b = start[at], end[to - 1]
    if len(raw) != len(text):  # bytes to code points
        points = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
        a, b = points[a], points[b]
    return digest.view(np.int64), (to - at).astype(np.int64), a.astype(np.int64), b.astype(np.int64)


def text_key(text: str) -> int:
    """A 64-bit id of a text, which tells rows with the same doc_id apart."""
    w = word_hashes(text)
    total = (w * _rolling(_B, len(w))[: len(w)]).sum(dtype=np.uint64)
    return int(mix(np.array([total + np.uint64(len(text))], np.uint64)).view(np.int64)[0])


def _later(cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (digest, rank), repeated rows out; which rows aren't first, and the first row's place for each."""
    digest, doc, key, place = cols[:4]
    order = np.lexsort((place, key, doc, digest))
    d, i, k, p = (x[order] for x in (digest, doc, key, place))
    fresh = np.ones(len(d), bool)
    fresh[1:] = (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (k[1:] != k[:-1]) | (p[1:] != p[:-1])
    order, d = order[fresh], d[fresh]
    new = np.ones(len(d), bool)
    new[1:] = d[1:] != d[:-1]
    lead = np.maximum.accumulate(np.where(new, np.arange(len(d)), 0))
    return order, ~new, order[lead]


def _batch(cols: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, mask=(c == _EMPTY) if n in ("doc_id", "earlier") else None) for n, c in zip(_NAMES, cols, strict=True)], names=_NAMES)


def unit_rows(docs: DataFrame) -> DataFrame:
    """A row a unit; inside an Arrow batch only the first of equal units is a candidate, the rest know an ``earlier`` document.

    ``place`` is words before << 24 | words, ``span`` start << 32 | length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in batches:
                out: list[list[np.ndarray]] = [[] for _ in range(5)]
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if not text:
                        continue
                    digest, words, start, end = units(text)
                    m = len(digest)
                    for col, v in zip(out, (digest, np.full(m, _EMPTY if doc is None else doc, np.int64), np.full(m, text_key(text), np.int64), (np.cumsum(words) - words) << 24 | np.minimum(words, (1 << 24) - 1), start << 32 | (end - start)), strict=True):
                        col.append(v)
                if out[0]:
                    cols = [np.concatenate(c) for c in out]
                    order, later, lead = _later(cols)
                    earlier = np.where(later, cols[1][lead], _EMPTY)
                    # an earlier row without an id leaves no mark of its own: such rows stay candidates
                    yield _batch([*(c[order] for c in cols), earlier])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _SCHEMA)


def repeats(rows: DataFrame) -> DataFrame:
    """The unit rows that aren't the first of their digest, with the ``earlier`` document each is a copy of.

    Rows come sorted and stream through: a task remembers one row, however many
    a digest has.
    """
    where = F.when(F.col("earlier").isNull(), F.col("digest")).otherwise(F.xxhash64("doc_id", "key", "place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # digest, doc_id, key, place and keeper of the row before
        for b in batches:
            known = b.column(5).is_valid()
            if known.true_count:
                yield b.filter(known)
            rest = b.filter(pc.invert(known))
            if not rest.num_rows:
                continue
            cols = [rest.column(k).fill_null(_EMPTY).to_numpy(zero_copy_only=False) for k in range(5)]
            if last is not None:
                cols = [np.concatenate(([v], c)) for v, c in zip(last, cols, strict=True)]
            digest, doc = cols[0], cols[1]
            new = np.ones(len(digest), bool)
            new[1:] = digest[1:] != digest[:-1]
            again = np.zeros(len(digest), bool)  # a repeated row, the same occurrence once more
            again[1:] = ~new[1:] & np.logical_and.reduce([c[1:] == c[:-1] for c in cols[1:4]])
            keeper = doc[np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))]
            if last is not None and digest[0] == kept_digest:
                keeper[: int(np.argmax(new[1:])) + 1 if new[1:].any() else len(keeper)] = kept
            later = ~new & ~again
            last, kept, kept_digest = [c[-1] for c in cols], keeper[-1], digest[-1]
            if later.any():
                yield _batch([*(c[later] for c in cols), keeper[later]])

    order = ["digest", F.asc_nulls_last("doc_id"), "key", "place"]
    return rows.repartition(where).sortWithinPartitions(*order).mapInArrow(run, _SCHEMA)


def shared_filter(docs: DataFrame, stretch: int = STRETCH) -> np.ndarray:
    """A bitmap of the fingerprints that occur more than once; other fingerprints may share their bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in batches:
                found, most = [np.empty(0, np.uint64)], stretch - GRAM + 1
                for text in b.column(0).to_pylist():
                    least = fingerprints(word_hashes(text), stretch) if text else found[0]
                    if len(least):
                        at = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
                        long = np.diff(np.append(at, len(least))) > most  # more windows than one occurrence has
                        found += [least[at], least[at][long]]
                value, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n)], names=["f", "n"])

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "f long, n long")
    shared = cut(counted.groupBy("f").agg(F.sum("n").alias("n")).filter("n > 1").select("f"))
    bits = min(FILTER_BITS, max(16, (8 * shared.count()).bit_length()))
    slot = F.col("f").bitwiseAND(F.lit((1 << bits) - 1))
    octets = shared.groupBy(F.shiftright(slot, 3).cast("int").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), slot.bitwiseAND(F.lit(7)).cast("int"))).cast("short").alias("octet")).toArrow()
    out = np.zeros(1 << bits - 3, np.uint8)
    out[octets.column("at").to_numpy()] = octets.column("octet").to_numpy()
    return out


def window_rows(docs: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """A row for neighbouring windows with the same fingerprint, if that is shared: digests and spans of the windows, ``ordinal`` words before the first."""
    shared = docs.sparkSession.sparkContext.broadcast(shared_filter(docs, stretch))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        octets = shared.value
        mask = np.uint64(8 * len(octets) - 1)
        with np.errstate(over="ignore"):
            for b in batches:
                rows: list[list[np.ndarray]] = [[] for _ in range(4)]
                sizes, digests, spans = [], [], []
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if not text:
                        continue
                    words = word_hashes(text)
                    least = fingerprints(words, stretch)
                    slot = least & mask
                    open_ = octets[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1 != 0
                    p = np.flatnonzero(open_)
                    if not len(p):
                        continue
                    raw, buf, start, end = _word_edges(text)
                    a, z = start[p], end[p + stretch - 1]
                    if len(raw) != len(text):
                        points = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
                        a, z = points[a], points[z]
                    at = np.flatnonzero(np.concatenate(([True], (least[p[1:]] != least[p[:-1]]) | (p[1:] != p[:-1] + 1))))
                    m = len(at)
                    for col, v in zip(rows, (least[p[at]].view(np.int64), np.full(m, _EMPTY if doc is None else doc, np.int64), np.full(m, text_key(text), np.int64), p[at].astype(np.int64)), strict=True):
                        col.append(v)
                    sizes.append(np.diff(np.append(at, len(p))))
                    digests.append(_grams(words, stretch)[p].view(np.int64))
                    spans.append(a.astype(np.int64) << 32 | (z - a))
                if sizes:
                    f, ids, key, ordinal = (np.concatenate(c) for c in rows)
                    offsets = pa.array(np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype(np.int32))
                    lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(c))) for c in (digests, spans)]
                    yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(ids, mask=ids == _EMPTY), pa.array(key), pa.array(ordinal), *lists], names=["f", "doc_id", "key", "ordinal", "digests", "spans"])

    schema = "f long, doc_id long, key long, ordinal long, digests array<bigint>, spans array<bigint>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def repeated_stretches(docs: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Neighbouring windows that have to go, a row each: doc_id, key, ordinal (words before), n_words, start, end, kept.

    A window goes if its first occurrence is in another document, or in the same
    one without overlapping it. Windows are dealt by fingerprint and stream
    through sorted; what is joined again lies in the same task.
    """

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = None  # digest, doc_id, key and ordinal of the first row of the digest before
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(k).fill_null(_EMPTY).to_numpy(zero_copy_only=False) for k in range(5)]
            if lead is not None:
                cols = [np.concatenate(([v], c)) for v, c in zip([*lead, 0], cols, strict=True)]
            digest, doc, key, ordinal, span = cols
            first = np.maximum.accumulate(np.where(np.concatenate(([True], digest[1:] != digest[:-1])), np.arange(len(digest)), 0))
            go = (doc != doc[first]) | (key != key[first]) | (ordinal - ordinal[first] >= stretch)
            lead = [c[first[-1]] for c in cols[:4]]
            kept = doc[first][go]
            yield pa.RecordBatch.from_arrays([pa.array(doc[go], mask=doc[go] == _EMPTY), pa.array(key[go]), pa.array(ordinal[go]), pa.array(span[go]), pa.array(kept, mask=kept == _EMPTY)], names=["doc_id", "key", "ordinal", "span", "kept"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            doc, key, ordinal, span, kept = (b.column(k).fill_null(_EMPTY).to_numpy(zero_copy_only=False) for k in range(5))
            gap = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (ordinal[1:] - ordinal[:-1] > 1)
            at = np.flatnonzero(np.concatenate(([True], gap)))
            last = np.append(at[1:], len(doc)) - 1
            low = np.minimum.reduceat(kept, at)
            start, end = span[at] >> 32, (span[last] >> 32) + (span[last] & 0xFFFFFFFF)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[at], mask=doc[at] == _EMPTY), pa.array(key[at]), pa.array(ordinal[at]), pa.array(ordinal[last] - ordinal[at] + stretch), pa.array(start), pa.array(end), pa.array(low, mask=low == _EMPTY)],
                names=["doc_id", "key", "ordinal", "n_words", "start", "end", "kept"],
            )

    dealt = window_rows(docs, stretch).repartition("f")
    each = dealt.select("doc_id", "key", "ordinal", F.posexplode(F.arrays_zip("digests", "spans")).alias("k", "w"))
    each = each.select(F.col("w.digests").alias("digest"), "doc_id", "key", (F.col("ordinal") + F.col("k")).alias("ordinal"), F.col("w.spans").alias("span"))
    gone = each.sortWithinPartitions("digest", F.asc_nulls_last("doc_id"), "key", "ordinal").mapInArrow(later, "doc_id long, key long, ordinal long, span long, kept long")
    return gone.sortWithinPartitions("doc_id", "key", "ordinal").mapInArrow(joined, "doc_id long, key long, ordinal long, n_words long, start long, end long, kept long")


def removed_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per removed run: doc_id, key (of the text), start, end (code points, end exclusive), n_words, kept_doc_id.

    Removed are lines and sentences that an earlier ranked text has, in runs of
    ``min_words`` words and more (0: every repeated line or sentence), and every
    repeat of STRETCH words wherever units begin.

    ``kept_doc_id`` is the smallest document that holds a unit or window of the
    run earlier. Rows repeated with the same id and text are one occurrence; a
    null doc_id ranks last; null and empty texts have no units; other columns are
    ignored. Equal occurrences in one text rank by place; very long texts are cut
    into units whole; an empty table has no runs. A unit that a large share of all rows has leaves each Arrow batch
    once, so its group stays small.
    """
    small_batches(docs.sparkSession)
    again = cut(repeats(unit_rows(docs)))
    # an Arrow batch may know a nearer copy only; the smallest of a digest's is the one that stays
    # kept apart from the join below, whose two plain shuffles Spark can then split at a very common digest
    first = cut(again.groupBy("digest").agg(F.min("earlier").alias("kept")))
    ordinal, words = F.shiftright("place", 24), F.col("place").bitwiseAND(F.lit((1 << 24) - 1))
    start = F.shiftright("span", 32)
    flagged = again.select("digest", "doc_id", "key", ordinal.alias("ordinal"), words.alias("words"), start.alias("start"), (start + F.col("span").bitwiseAND(F.lit((1 << 32) - 1))).alias("end"))
    in_text = W.partitionBy("doc_id", "key").orderBy("ordinal")
    before = in_text.rowsBetween(W.unboundedPreceding, -1)
    runs = flagged.withColumn("run", F.col("ordinal") - F.coalesce(F.sum("words").over(before), F.lit(0)))
    long_runs = runs.withColumn("n_words", F.sum("words").over(W.partitionBy("doc_id", "key", "run"))).filter(F.col("n_words") >= min_words)
    whole = long_runs.join(first, "digest").groupBy("doc_id", "key", "run")
    whole = whole.agg(F.min("ordinal").alias("ordinal"), F.sum("words").alias("n_words"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("kept").alias("kept")).drop("run")
    parts = whole.unionByName(repeated_stretches(docs, max(min_words, STRETCH))).withColumn("to", F.col("ordinal") + F.col("n_words"))
    apart = F.coalesce(F.col("ordinal") > F.max("to").over(before), F.lit(True)).cast("long")
    merged = parts.withColumn("apart", apart).withColumn("run", F.sum("apart").over(in_text.rowsBetween(W.unboundedPreceding, 0))).groupBy("doc_id", "key", "run")
    return merged.agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.max("to") - F.min("ordinal")).alias("n_words"), F.min("kept").alias("kept_doc_id")).drop("run")


def contract(docs: DataFrame) -> DataFrame:
    """A row a removed run; ``removed_runs`` defines nulls, empty and long texts, ties, repeats and further columns."""
    return removed_runs(docs).select("doc_id", "start", "end", "n_words", "kept_doc_id")


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents, all columns, with ``text`` cut and ``removed`` array<struct<start,end>> of original offsets (in place of a column of that name).

    Null and empty texts and texts without repeats stay as they are with an
    empty ``removed``; rows that repeat id and text are cut alike; null ids are
    ids of their own text; an empty table stays empty.
    """
    spans = removed_runs(docs, min_words).groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("removed"))
    kind = "array<struct<start:bigint,end:bigint>>"

    @F.pandas_udf("long")
    def key_of(s):
        with np.errstate(over="ignore"):
            return s.map(lambda t: text_key(t) if isinstance(t, str) and t else None).astype("Int64")

    texts = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    keyed = texts.withColumn("k", key_of("text"))
    got = keyed.join(spans.select(F.col("doc_id").alias("i"), "key", "removed"), F.col("id").eqNullSafe(F.col("i")) & (F.col("k") == F.col("key")), "left")
    # what stays lies between the end of one run and the start of the next
    removed = F.coalesce("removed", F.array().cast(kind))
    stays = F.zip_with(
        F.concat(F.array(F.lit(0).cast("long")), F.transform(removed, lambda s: s.end)),
        F.concat(F.transform(removed, lambda s: s.start), F.array(F.char_length("text").cast("long"))),
        lambda a, b: F.substring(F.col("text"), (a + 1).cast("int"), (b - a).cast("int")),
    )
    out = got.select("row", F.when(F.size(removed) > 0, F.array_join(stays, "")).otherwise(F.col("text")).alias("text"), removed.alias("removed"))
    return out.select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c != "removed"), "removed")
