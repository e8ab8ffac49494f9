"""Benchmark decontamination by spaced seeds; DataFrame functions only.

A fixed mask looks at some positions of a window of words and ignores the
others, so a window still hits after its ignored words were replaced. Hashes of
masked windows of the benchmark and of the documents are joined; each hit gives
a document, an item and a diagonal, along which words are compared one to one.
An item is found where some stretch of ``STRETCH`` words agrees in three words
of four.

The masks miss no such stretch: whichever 3 of 13 words are replaced, one of
them finds a window without a replaced word that it looks at.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, few

#: Fixed masks: 1 looks at a word, 0 ignores it. Found by a greedy search for few masks of six words that cover all
#: 286 ways to replace 3 of 13 words.
MASKS = ("1101111", "1110100011", "111001011", "11010111", "101000110101")
#: Words of the shortest window; shorter items must be found whole.
SPAN = min(map(len, MASKS))
STRETCH = 13
SHARE = 0.75
#: Benchmark seeds (about 40 bytes each) up to which they are broadcast; beyond, both sides are shuffled.
MAX_BROADCAST = 500_000

SPLIT = r"[^\p{L}\p{N}]+"


def word_hashes(text: str) -> Column:
    """Hashes of the lower-case words (runs of letters and digits) of a text column."""
    return F.transform(F.filter(F.split(F.lower(F.col(text)), SPLIT), lambda x: x != ""), lambda x: F.xxhash64(x))


def seeds(rows: DataFrame, lengths: tuple[int, ...] = (), words: str = "w") -> DataFrame:
    """A row for each window under a mask, and for each run of one of the ``lengths``: ``rows``' columns, ``i`` (its first word) and ``seed``."""
    least = min((SPAN, *lengths))
    # no filter on the size: it would be pushed below the hashing, which then runs twice
    at = rows.select("*", F.explode(F.when(F.size(words) >= least, F.sequence(F.lit(0), F.size(words) - least))).alias("i"))
    w, i = F.col(words), F.col("i")
    fits = lambda n, seed: F.when(i + n <= F.size(words), seed)
    masked = [fits(len(mask), F.xxhash64(F.lit(m), *(F.get(w, i + k) for k, c in enumerate(mask) if c == "1"))) for m, mask in enumerate(MASKS)]
    whole = [fits(n, F.xxhash64(F.lit(-n), *(F.get(w, i + k) for k in range(n)))) for n in lengths]
    return at.select("*", F.explode(F.array(*masked, *whole)).alias("seed")).filter("seed is not null")


def item_seeds(items: DataFrame) -> DataFrame:
    """(item_id, item_key, j, item_seed) of the benchmark: windows under the masks, and items of fewer words whole."""
    windows = seeds(items, (), "b").select("item_id", "item_key", F.col("i").alias("j"), F.col("seed").alias("item_seed"))
    n = F.size("b")
    whole = F.coalesce(*(F.when(n == k, F.xxhash64(F.lit(-k), *(F.get("b", F.lit(x)) for x in range(k)))) for k in range(1, SPAN)))
    short = items.filter((n > 0) & (n < SPAN)).select("item_id", "item_key", F.lit(0).alias("j"), whole.alias("item_seed"))
    return windows.unionByName(short).distinct()


def agreement(words: Column, item: Column, diagonal: Column) -> Column:
    """For each word of the item, 1 if the document has it at the same place of the diagonal, else 0."""
    return F.transform(item, lambda x, j: F.coalesce((F.get(words, j + diagonal) == x).cast("int"), F.lit(0)))


def best_stretch(agree: Column) -> Column:
    """Most agreeing words in any stretch of STRETCH words (of the whole item if it is shorter)."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(agree) - STRETCH + 1, F.lit(1)))
    return F.array_max(F.transform(starts, lambda s: F.aggregate(F.slice(agree, s, STRETCH), F.lit(0), lambda a, x: a + x)))


def diagonals(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, key, item_id, start, n_words, matched, stretch) of the diagonals along which an item is found; key is a hash of the text.

    Hits are hashes and places only, each (document, item, diagonal) once; words
    follow afterwards, to documents and items with a hit. Documents aren't
    shuffled to find hits while the benchmark's seeds are few enough to broadcast.
    """
    items = benchmark.select("item_id", word_hashes("text").alias("b")).withColumn("item_key", F.xxhash64("b"))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64("text"))
    lengths = tuple(sorted(r.n for r in items.select(F.size("b").alias("n")).filter((F.col("n") > 0) & (F.col("n") < SPAN)).distinct().collect()))
    probe = few(item_seeds(items), MAX_BROADCAST)
    at = seeds(texts.select("doc_id", "key", word_hashes("text").alias("w")), lengths).select("doc_id", "key", "i", "seed")
    met = at.join(probe, F.col("seed") == F.col("item_seed"))
    found = cut(met.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "item_id", "item_key", (F.col("i") - F.col("j")).alias("start")).distinct())
    of = few(found.select("d", "k").distinct())
    same = (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d"))
    worded = cut(texts.join(of, same, "left_semi").dropDuplicates(["doc_id", "key"]).select("doc_id", "key", word_hashes("text").alias("w")))
    b = items.distinct().select(F.col("item_id").alias("t"), F.col("item_key").alias("t_key"), "b")
    hits = worded.join(found, same).join(b, (F.col("item_key") == F.col("t_key")) & F.col("item_id").eqNullSafe(F.col("t")))
    # agreement is computed behind a generator so that it is computed once a hit
    judged = hits.select("doc_id", "key", "item_id", "start", F.explode(F.array(agreement(F.col("w"), F.col("b"), F.col("start")))).alias("agree"))
    judged = judged.select("doc_id", "key", "item_id", "start", F.size("agree").cast("long").alias("n_words"), F.aggregate("agree", F.lit(0), lambda a, x: a + x).cast("long").alias("matched"), best_stretch(F.col("agree")).cast("long").alias("stretch"))
    need = F.ceil(F.lit(SHARE) * F.least(F.col("n_words"), F.lit(STRETCH)))
    return judged.filter(F.col("stretch") >= F.when(F.col("n_words") < SPAN, F.col("n_words")).otherwise(need))


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row a (doc_id, item_id) with an overlap, its best diagonal's figures.

    Columns: doc_id, item_id, start (word index in the document at which the
    item's first word would stand), n_words (of the item), matched (agreeing
    words on the diagonal), stretch (best stretch); the diagonal with most
    matched words, then the best stretch, then the smallest start. Items of
    fewer words than a mask spans must occur whole. Rows that share a doc_id,
    also null, are judged together and repeated rows once. Null and empty texts
    and tables give no rows, very long texts are searched whole, other columns,
    whatever their names, are ignored.
    """
    best = F.max(F.struct("matched", "stretch", (-F.col("start")).alias("s"), "n_words")).alias("best")
    grouped = diagonals(docs, benchmark).groupBy("doc_id", "item_id").agg(best)
    return grouped.select("doc_id", "item_id", (-F.col("best.s")).cast("long").alias("start"), "best.n_words", "best.matched", "best.stretch")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns, that overlap no benchmark item.

    Each text is judged by itself, so another text of the same id, or without
    id, stays. Null and empty texts stay; repeated rows stay or go together;
    very long texts are searched whole; empty tables take and lose nothing.
    """
    hit = few(diagonals(docs, benchmark).select(F.col("doc_id").alias("__hit"), F.col("key").alias("__key")).distinct())
    key = F.xxhash64(docs["text"].cast("string"))
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["__hit"]) & (key == hit["__key"]), "left_anti")


def _sql() -> str:
    seed = "[" + ", ".join(f"CASE WHEN i + {len(m)} <= len(w) THEN '{k}:' || " + " || ' ' || ".join(f"w[i + {x + 1}]" for x, c in enumerate(m) if c == "1") + " END" for k, m in enumerate(MASKS)) + "]"
    words = f"list_filter(regexp_split_to_array(lower(text), '{SPLIT}'), lambda x: x <> '')"
    rows = lambda name, key, table: f"{name}w AS (SELECT {key}, {words} AS w FROM {table}), {name} AS (SELECT {key}, w, i, unnest({seed}) AS seed FROM (SELECT {key}, w, unnest(range(0, len(w) - {SPAN - 1})) AS i FROM {name}w))"
    return f"""
        WITH {rows("d", "doc_id", "documents")}, {rows("b", "item_id", "benchmark")},
        n AS (SELECT DISTINCT len(w) AS n FROM bw WHERE len(w) BETWEEN 1 AND {SPAN - 1}),
        x AS (SELECT doc_id, w, n, i, array_to_string(w[i + 1 : i + n], ' ') AS whole
              FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM dw, n)),
        h AS (SELECT DISTINCT doc_id, item_id, d.i - b.i AS start, d.w AS w, b.w AS b FROM d JOIN b ON d.seed = b.seed
              UNION SELECT doc_id, item_id, i AS start, x.w AS w, bw.w AS b FROM x JOIN bw ON len(bw.w) = n AND array_to_string(bw.w, ' ') = whole),
        a AS (SELECT doc_id, item_id, start, len(b) AS n_words,
              list_transform(range(1, len(b) + 1), lambda j: CASE WHEN j + start >= 1 AND w[j + start] = b[j] THEN 1 ELSE 0 END) AS agree FROM h),
        s AS (SELECT doc_id, item_id, start, n_words, list_sum(agree) AS matched,
              list_max(list_transform(range(1, greatest(n_words - {STRETCH} + 1, 1) + 1), lambda s: list_sum(agree[s : s + {STRETCH - 1}]))) AS stretch FROM a),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, stretch DESC, start) AS k
              FROM s WHERE stretch >= CASE WHEN n_words < {SPAN} THEN n_words ELSE ceil({SHARE} * least(n_words, {STRETCH})) END)
        SELECT doc_id, item_id, CAST(start AS BIGINT) AS start, CAST(n_words AS BIGINT) AS n_words, CAST(matched AS BIGINT) AS matched,
               CAST(stretch AS BIGINT) AS stretch FROM r WHERE k = 1"""


SQL = _sql()
NEED = ceil(SHARE * STRETCH)


def contract(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``overlaps``, whose docstring defines nulls, empty and long texts, ties, repeats, empty tables and further columns."""
    return overlaps(docs, benchmark)
