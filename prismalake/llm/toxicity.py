"""Toxicity by Levenshtein automata over a lexicon trie.

The lexicon is learned from labelled rows: words, and stems that begin several
words, which occur in many different contexts of toxic texts and hardly ever in
clean ones. It is kept as a trie; the Levenshtein automata of all its terms are
run on a word at once, as one automaton whose states are sets of (trie node,
edits so far), made on demand. Every hit is scored inside a window of words, in
which quotation marks, reporting words or a second person tell a quotation from
abuse.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, few, small_batches

#: Labelled rows that training reads at most (expected; rows are chosen by a hash of their id).
MAX_TRAIN = 20_000
#: Different contexts in toxic texts that a term needs at least (more if chance would give a word of the vocabulary
#: as many), and the odds ratio it must reach.
MIN_SUPPORT, MIN_ODDS = 3, 20.0
CHANCE = 0.05
STEM_LENGTHS = (4, 5, 6)
WINDOW = 8
#: Words before or behind a hit among which a reporting word counts, and places around a term at two of which words have to differ.
REPORTED_WITHIN, NEIGHBOURS = 3, (-4, -1, 1, 4)

#: A word: letters and digits with the signs that stand for letters in disguised words.
WORD = re.compile(r"[^\W_]+(?:[@$!*'][^\W_]+)*")
#: The same without Python, for training counts: letters only.
LETTERS = r"\p{L}+"
#: Fixed cues.
QUOTES = "\"'“”‘’«»„‚`"
REPORTING = {
    "said", "says", "say", "wrote", "writes", "quote", "quoted", "quotes", "quoting", "called", "term", "word", "phrase",
    "insult", "slur", "reported", "according", "dit", "mot", "cité", "sagte", "wort", "zitat", "dijo", "palabra", "cita",
}
SECOND_PERSON = {"you", "your", "you're", "ur", "u", "toi", "tu", "vous", "du", "dich", "dein", "ihr", "tú", "usted"}
QUOTED_SHARE = 0.45
#: Share of a term's probability at 1 and 2 edits if training has seen no word that near.
UNSEEN_NEAR = (0.9, 0.75)
ABUSE_SHARE = 1.15


def edits_for(term: str) -> int:
    """Edits that a misspelling of a term may have: none below 5 letters, 1 below 9, else 2."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


@dataclass
class Lexicon:
    """Terms with the probability that a text holding them is toxic, stems, and near words known to be clean."""

    terms: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    clean: set[str] = field(default_factory=set)
    near: dict[str, list[float]] = field(default_factory=dict)  # share of a term's probability at 1 and 2 edits
    prior: float = 0.1

    def to_json(self) -> str:
        return json.dumps({"terms": self.terms, "stems": self.stems, "clean": sorted(self.clean), "near": self.near, "prior": self.prior}, ensure_ascii=False, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> "Lexicon":
        x = json.loads(text)
        return Lexicon(x["terms"], x["stems"], set(x["clean"]), x["near"], x["prior"])


class Matcher:
    """The lexicon's automaton.

    A state is the set of (node, edits) pairs the automata may be in. Transitions
    are computed once and kept; ``MAX_STATES`` bounds the memory (the table
    starts anew beyond it, which changes no result).
    """

    MAX_STATES = 100_000

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.most: list[int] = [0]
        for t in lexicon.terms:
            self.term[self._insert(t, edits_for(t))] = t
        for t in lexicon.stems:
            self.stem[self._insert(t, 0)] = t
        self._reset()

    def _insert(self, term: str, edits: int) -> int:
        node = 0
        self.most[0] = max(self.most[0], edits)
        for c in term:
            if c not in self.children[node]:
                self.children[node][c] = len(self.children)
                self.children.append({})
                self.term.append(None)
                self.stem.append(None)
                self.most.append(0)
            node = self.children[node][c]
            self.most[node] = max(self.most[node], edits)
        return node

    def _closed(self, pairs: dict[int, int]) -> frozenset:
        """With letters of the term left out; the fewest edits of each node."""
        todo = list(pairs.items())
        while todo:
            node, e = todo.pop()
            if pairs[node] < e:
                continue
            for child in self.children[node].values():
                if e + 1 <= self.most[child] and pairs.get(child, 99) > e + 1:
                    pairs[child] = e + 1
                    todo.append((child, e + 1))
        return frozenset(pairs.items())

    def _reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[str, int] | None] = []
        self.stems_at: list[str | None] = []
        self._id(frozenset())  # state 0 is dead
        self.start = self._id(self._closed({0: 0}))

    def _id(self, state: frozenset) -> int:
        if state not in self.ids:
            self.ids[state] = len(self.sets)
            self.sets.append(state)
            self.moves.append({})
            best = min(((e, self.term[n]) for n, e in state if self.term[n] is not None and e <= edits_for(self.term[n])), default=None)
            self.accepts.append((best[1], best[0]) if best else None)
            self.stems_at.append(next((self.stem[n] for n, e in sorted(state) if e == 0 and self.stem[n] is not None), None))
        return self.ids[state]

    def _move(self, state: int, c: str) -> int:
        pairs: dict[int, int] = {}

        def put(node: int, e: int) -> None:
            if e <= self.most[node] and pairs.get(node, 99) > e:
                pairs[node] = e

        for node, e in self.sets[state]:
            hit = self.children[node].get(c)
            if hit is not None:
                if pairs.get(hit, 99) > e:
                    pairs[hit] = e
            if e < self.most[node]:
                put(node, e + 1)
                for child in self.children[node].values():
                    put(child, e + 1)
        new = self._id(self._closed(pairs))
        self.moves[state][c] = new
        return new

    def match(self, word: str) -> tuple[str, int, bool] | None:
        """(term, edits, is a stem) of a lower-case word, or None."""
        if len(self.sets) > self.MAX_STATES:
            self._reset()
        state, stem = self.start, None
        moves, stems = self.moves, self.stems_at
        for c in word:
            nxt = moves[state].get(c)
            if nxt is None:
                nxt = self._move(state, c)
            state = nxt
            if stem is None and stems[state] is not None:
                stem = stems[state]
            if not state:
                break
        hit = self.accepts[state]
        if hit is not None and hit[1] == 0:
            return hit[0], 0, False
        if stem is not None:
            return stem, 0, True
        if hit is not None and word not in self.lexicon.clean:
            return hit[0], hit[1], False
        return None

    def weight(self, word: str, hit: tuple[str, int, bool]) -> float:
        term, edits, is_stem = hit
        if is_stem:
            return self.lexicon.stems[term]
        if not edits or not word.isalpha():  # signs and digits inside a word disguise it
            return self.lexicon.terms[term] * (1.0, 0.95, 0.85)[edits]
        return self.lexicon.terms[term] * self.lexicon.near.get(term, UNSEEN_NEAR)[edits - 1]

    def score(self, text: str | None) -> float:
        """Probability-like score of a whole text."""
        base = min(0.2, self.lexicon.prior)
        if not text:
            return base / 2
        lower = text.lower()
        hits = {}
        match = self.match
        for w in set(WORD.findall(lower)):
            found = match(w)
            if found is not None:
                hits[w] = self.weight(w, found)
        if not hits:
            return base / 2
        words = [(m.group(), m.start(), m.end()) for m in WORD.finditer(lower)]
        clear, weak = 1.0 - base, 0.0
        for i, (w, a, b) in enumerate(words):
            if w in hits:
                p = hits[w]
                near = words[max(0, i - WINDOW) : i + WINDOW + 1]
                addressed = any(x in SECOND_PERSON for x, _, _ in near)
                if addressed:
                    p = min(0.99, p * ABUSE_SHARE)
                if self._in_quotation(lower, near[0][1], a, b, near[-1][2]):
                    weak = max(weak, p * QUOTED_SHARE)
                elif not addressed and any(x in REPORTING for x, _, _ in words[max(0, i - REPORTED_WITHIN) : i + REPORTED_WITHIN + 1]):
                    clear *= 1.0 - p * QUOTED_SHARE  # one report is weak, a text full of them isn't
                elif p < 0.5:
                    weak = max(weak, p)  # many doubtful hits don't add up to a clear one
                else:
                    clear *= 1.0 - p
        return max(1.0 - clear, weak)

    @staticmethod
    def _in_quotation(text: str, first: int, a: int, b: int, last: int) -> bool:
        """A quotation mark on either side of the hit, inside its window; apostrophes inside words don't count."""
        mark = rf"(?<!\w)[{QUOTES}](?=\w)"
        return re.search(mark, text[first : a + 1]) is not None and re.search(rf"(?<=[\w.,!?])[{QUOTES}](?!\w)", text[b - 1 : last + 2]) is not None


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Lexicon:
    """Learn a lexicon from labelled documents whose crc32(doc_id as text) mod 5 isn't 0.

    Rows without id, text or label teach nothing; a doc labelled twice counts by
    its largest label. About ``max_train`` rows are read, chosen by a hash. Words
    are counted by distinct contexts (words around them), so a text copied a
    thousand times counts once; a term must also have as many different words at
    two of the places around it, which near copies of one text don't show.
    Terms and near words are as many as the bounded sample has, without a cap of
    their own. Empty tables teach nothing.
    """
    spark = docs.sparkSession
    known = (
        labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
        .filter("id is not null and toxic is not null and crc32(cast(id as string)) % 5 <> 0")
        .groupBy("id")
        .agg(F.max("toxic").alias("toxic"))
    )
    total = known.count()
    if not total:
        return Lexicon()
    share = min(1.0, max_train / total)
    known = known.filter(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1_000_000)) < int(share * 1_000_000))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    sample = known.hint("broadcast") if total * share <= 2 * max_train else known
    rows = texts.join(sample, "id").filter("text is not null")
    tokens = rows.select("id", "toxic", F.regexp_extract_all(F.lower("text"), F.lit(f"({LETTERS})"), 1).alias("w"))
    at = tokens.select("toxic", "w", F.posexplode("w").alias("i", "word"))
    around = [F.get("w", F.col("i") + k) for k in NEIGHBOURS]
    seen = at.select("toxic", "word", F.xxhash64(*around).alias("context"))
    contexts = seen.groupBy("word", "context").agg(F.max("toxic").alias("t"), F.min("toxic").alias("c"))
    words = cut(
        contexts.groupBy("word").agg(
            F.sum(F.col("t")).cast("long").alias("t"), F.sum(1 - F.col("c")).cast("long").alias("c")
        )
    )
    sums = words.agg(F.sum("t"), F.sum("c"), F.count("*")).first()
    n_t, n_c = (sums[0] or 0) + 1, (sums[1] or 0) + 1
    least = max(MIN_SUPPORT, math.ceil(math.log(CHANCE / max(1, sums[2])) / math.log(n_t / (n_t + n_c))))
    odds = ((F.col("t") + 0.5) / n_t) / ((F.col("c") + 0.5) / n_c)
    strong = (F.col("t") >= least) & (odds >= MIN_ODDS) & (F.col("c") <= 0.02 * F.col("t"))
    likely = cut(words.filter(strong & (F.length("word") >= 4)))
    differ = [F.count_distinct(F.coalesce(x, F.lit(""))).alias(f"n{k}") for k, x in enumerate(around)]
    met = at.filter("toxic = 1").join(few(likely.select("word")), "word").groupBy("word").agg(*differ)
    second = F.element_at(F.sort_array(F.array(*(f"n{k}" for k in range(len(differ)))), asc=False), 2)
    terms = likely.join(met.filter(second >= least).select("word"), "word").collect()
    heads = words.filter(F.length("word") > min(STEM_LENGTHS)).select(
        F.explode(F.array_distinct(F.transform(F.array(*map(F.lit, STEM_LENGTHS)), lambda k: F.substring("word", F.lit(1), k)))).alias("word"), "t", "c"
    )
    stems = heads.groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.count("*").alias("n"), F.sum((F.col("t") > 1).cast("int")).alias("n2"))
    stems = stems.filter(strong & (F.length("word") >= 4) & (F.col("n2") >= 4) & (F.col("t") >= 2 * least)).collect()
    prob = lambda r: round((r.t + 0.5) / (r.t + 20 * r.c + 1.0), 4)
    lexicon = Lexicon({r.word: prob(r) for r in terms}, {r.word: prob(r) for r in stems}, prior=0.1)
    if lexicon.terms:
        _learn_near(words, lexicon)
    return lexicon


def _learn_near(words: DataFrame, lexicon: Lexicon) -> None:
    """Clean words within reach of each term, and from them how toxic words near it are at large."""
    text = lexicon.to_json()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(Lexicon.from_json(text))
        names, kinds = ["word", "t", "c", "term", "e"], (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32())
        for b in batches:
            got = [(w, t, c, h[0], h[1]) for w, t, c in zip(*(x.to_pylist() for x in b.columns), strict=True) if (h := m.match(w)) and h[1]]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*got, strict=True), kinds, strict=True)], names=names)

    near = cut(words.mapInArrow(run, "word string, t long, c long, term string, e int"))
    lexicon.clean = {r.word for r in near.filter("c > 0").select("word").collect()}
    found = near.groupBy("term").agg(*(F.count_if((F.col("e") == e) & cond).alias(f"{k}{e}") for e in (1, 2) for k, cond in (("t", F.col("c") == 0), ("c", F.col("c") > 0)))).collect()
    # a word near the term that training hasn't seen is as bad as those that it has; two toxic ones are assumed
    lexicon.near = {r.term: [round(u * (r[f"t{e}"] + 2.0) / (r[f"t{e}"] + r[f"c{e}"] + 2.0), 4) for e, u in zip((1, 2), UNSEEN_NEAR)] for r in found}


def score(docs: DataFrame, lexicon: Lexicon, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Columns ``keep`` (none of them called score) and ``score`` (0 to 1) of every row; narrow.

    Null, empty and wordless texts score low, very long texts are scored whole,
    repeated rows score alike, an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    schema = docs.select(*keep).schema.add("score", "double")
    sent, n = lexicon.to_json(), len(keep)
    at = keep.index(text_col) if text_col in keep else n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(Lexicon.from_json(sent))
        for b in batches:
            scores = pa.array([m.score(t) for t in b.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[:n], scores], names=[*keep, "score"])

    extra = [] if at < n else [F.col(text_col).cast("string").alias("__text")]
    return docs.select(*keep, *extra).mapInArrow(run, schema)


def contract(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score and prediction of every document; the held-out fifth never teaches.

    A null id is not held out and teaches nothing; ``score`` defines null, empty
    and long texts, repeats and empty tables; ties of the score are predicted 1
    at 0.5; further columns, whatever their names, are ignored.
    """
    got = score(docs, train(docs, labels))
    return got.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"),
        F.round("score", 6).alias("score"),
        (F.round("score", 6) >= 0.5).cast("int").alias("predicted"),
    )


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents, all columns, that score below the threshold; rows without id or text are scored like all others.

    Repeated rows stay or go together; without labels every document stays; an
    empty table stays empty; columns keep their names.
    """
    small_batches(docs.sparkSession)
    sent, at = train(docs, labels).to_json(), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(Lexicon.from_json(sent))
        for b in batches:
            yield b.filter(pa.array([m.score(t) < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
