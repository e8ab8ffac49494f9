"""Secret scans by assignment-aware lexing.

The text is read as if it were source or configuration: assignments give
name-literal pairs, constants are propagated through later references and
concatenations, and each literal is scored by how sensitive its target name is
and how much it looks like key material. Three fixed base patterns are always
reported; the lexer only adds spans.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, small_batches

#: Kinds in the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "literal")

ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, so the length limit may stand in the pattern

#: A quoted literal (with a prefix of the usual letters, in one of the usual quotes, or three of them over several lines) and a name.
_STRING = (
    r"(?>(?:[bBrRuUfFL@$]{1,2})?(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''"
    r"|\"[^\"\n\\]*(?:\\.[^\"\n\\]*)*\"|'[^'\n\\]*(?:\\.[^'\n\\]*)*'|`[^`\n]*`))"
)
_TERM = rf"(?:{_STRING}|[A-Za-z_$][A-Za-z0-9_.$\{{\}}]*)"
STRING, TERM = re.compile(_STRING, re.S), re.compile(_TERM, re.S)
#: A target and its operator. What follows may be a further target of a chain, or a type in front of the operator.
TARGET = re.compile(r"(?<![A-Za-z0-9_.\-])(?P<quote>[\"']?)(?P<name>[A-Za-z_][A-Za-z0-9_.\-]*)(?P=quote)\]?[ \t]*(?:=>|:=|<-|=(?![=~])|:)[ \t]*")
LINK = re.compile(r"(?:&(?:'[a-z]+[ \t]+)?|\*)?(?P<name>[A-Za-z_][A-Za-z0-9_.\-]*)(?:\[[^\]\n=]*\]|<[^>\n=]*>|[?!])?(?P<gap>[ \t]*)(?:=>|:=|=(?![=~])|:)[ \t]*")
#: Literals and names joined by an operator, or literals side by side.
RHS = re.compile(rf"{_TERM}(?:[ \t]*(?:\+|\.\.|\|\||&)[ \t]*(?:\\?\n[ \t]*)?{_TERM}|[ \t]*{_STRING})*", re.S)
#: A list, or literals that continue over lines, in brackets.
GROUP = re.compile(rf"[(\[]\s*{_STRING}(?:[\s,+\\]*{_STRING})*[\s,]*[)\]]", re.S)
#: Indented lines under a key.
LINES = re.compile(r"[|>][+\-]?[ \t]*\n(?P<lines>(?:[ \t]+[^\s].*(?:\n|\Z))+)")
#: Elements, and calls that set something.
ELEMENT = re.compile(r"<(?P<name>[A-Za-z_][A-Za-z0-9_.:\-]*)(?:[ \t][^<>]*)?>(?P<value>[^<>]+)</(?P=name)[ \t]*>")
CALL = re.compile(rf"(?<![A-Za-z0-9_])(?:set|with|use)_?(?P<name>[A-Za-z_][A-Za-z0-9_]*)\([ \t]*(?P<value>{_STRING})", re.S)
#: White space and a mark of comments at the beginning of a line.
MARGIN = re.compile(r"([ \t]*)(#|//|--|/?\*|%|REM\b)?")
#: The end of an unquoted value, and what may follow it if white space may be inside.
STOP = re.compile(r"[\s;,]|$")
TAIL = re.compile(r"[ \t]*(?:[;,\r\n#]|$)")
#: Unquoted code: calls, subscripts, quotes, references.
CODE = re.compile(r"[\"'`$]|^[A-Za-z_][A-Za-z0-9_.:]*[(\[]|^[&*(\[{<]")
NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

#: Fixed sensitivity of the parts of a target name.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "private": 0.6, "auth": 0.6, "key": 0.5, "access": 0.3, "api": 0.4,
    "signing": 0.4, "encryption": 0.4, "bearer": 0.8, "passphrase": 1.0,
}

#: Fixed stand-ins that are never secrets.
PLACEHOLDERS = {"changeme", "example", "placeholder", "none", "null", "true", "false", "todo", "xxxxxx", "your_key_here"}

#: Score from which an added literal is reported.
THRESHOLD = 0.6


def name_score(name: str) -> float:
    """Sensitivity of a target name, 0 to 1; its parts add up."""
    return min(1.0, sum(SENSITIVE.get(p.lower(), 0.0) for p in NAME_PART.findall(name)))


def _looks(counts: Counter, small: str | None) -> float:
    n = sum(counts.values())
    if n < 6 or (small is not None and small.lower() in PLACEHOLDERS):
        return 0.0
    if any(c.isspace() for c in counts) and not (any(c.isdigit() for c in counts) and any(c.isalpha() for c in counts)):
        return 0.0  # a sentence
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values() if c / n)
    return min(n, 16) / 16 * min(1.0, entropy / 3.0)


def literal_score(value: str) -> float:
    """How much a literal looks like key material: length and entropy a character, 0 to 1."""
    return _looks(Counter(value), value)


class Constant:
    """An assigned value: its own literals and the earlier constants that it is joined from."""

    def __init__(self) -> None:
        self.spans: list[tuple[int, int]] = []
        self.uses: list[Constant] = []
        self.counts: Counter = Counter()
        #: The value itself as long as a stand-in may be as long
        self.small: str | None = ""
        self.listed = False

    def _join(self, counts: Counter, small: str | None) -> None:
        for c, k in counts.items():
            self.counts[c] += k
        self.small = None if self.small is None or small is None or len(self.small) + len(small) > 64 else self.small + small

    def literal(self, text: str, start: int, end: int) -> None:
        self._join(Counter(text[start:end]), text[start:end])
        self.spans.append((start, end))

    def use(self, other: Constant) -> None:
        self._join(other.counts, other.small)
        self.uses.append(other)

    def score(self) -> float:
        return _looks(self.counts, self.small)

    def list_spans(self, out: set[tuple[int, int]]) -> None:
        """Add the spans of all literals of the value; each constant is gone through once."""
        todo = [self]
        while todo:
            c = todo.pop()
            if not c.listed:
                c.listed = True
                out.update(s for s in c.spans if s[1] - s[0] >= 3)
                todo += c.uses


def inner(text: str, start: int, end: int) -> tuple[int, int]:
    """What stands between the quotes of a literal."""
    while text[start] not in "\"'`":
        start += 1
    n = 3 if end - start >= 6 and text[start : start + 3] in ('"""', "'''") else 1
    return start + n, end - n


class Names:
    """Constants by name and indentation: what stands further in than a use may be out of scope, or not, so both count."""

    def __init__(self) -> None:
        self.at: dict[str, list[tuple[int, Constant]]] = {}

    def put(self, name: str, indent: int, value: Constant | None) -> None:
        """A new value; None forgets the old one. Values further in are forgotten as well."""
        left = [x for x in self.at.get(name, ()) if x[0] < indent]
        self.at[name] = left if value is None else [*left, (indent, value)]

    def get(self, name: str, indent: int) -> list[Constant]:
        """The value in scope first, then those further in."""
        found = self.at.get(name, ())
        near = [c for i, c in found if i <= indent]
        return near[-1:] + [c for i, c in found if i > indent]


def quoted(text: str, at: int, known: Names, indent: int) -> tuple[list[Constant], int]:
    """The values behind an operator, of literals and known names; none if it is neither."""
    if m := GROUP.match(text, at):
        values, last = [Constant()], None
        for t in STRING.finditer(text, at, m.end()):
            if last is not None and "," in text[last : t.start()]:
                values.append(Constant())
            values[-1].literal(text, *inner(text, t.start(), t.end()))
            last = t.end()
        return values, m.end()
    if m := LINES.match(text, at):
        value = Constant()
        for line in re.finditer(r"[^\s].*", m["lines"]):
            a, b = m.start("lines") + line.start(), m.start("lines") + line.start() + len(line.group().rstrip())
            value.literal(text, a, b)
        return [value], m.end()
    m, value = RHS.match(text, at), Constant()
    if m:
        terms = list(TERM.finditer(text, at, m.end()))
        for t in terms:
            word = t.group()
            if word[-1] in "\"'`":
                value.literal(text, *inner(text, t.start(), t.end()))
            elif found := known.get(word.strip("${}"), indent):
                if len(terms) == 1:
                    return found, m.end()
                value.use(found[0])
    return ([value], m.end()) if value.spans or value.uses else ([], at)


def margin(text: str, line: int) -> tuple[int, bool]:
    """Columns of white space that a line begins with, and whether it is a comment."""
    m = MARGIN.match(text, line)
    return len(m[1].expandtabs()), m[2] is not None


def lexed(text: str) -> list[tuple[int, int]]:
    """Spans of literals that the lexer takes for secrets.

    Every target of a chain gets its value; a value that isn't understood makes
    its targets unknown. Right sides without a literal or a known name are
    unquoted values, up to white space, ; or , behind a tight ``=``, otherwise
    up to the end of the line, ; , or a comment. A value with white space inside
    must be quoted, and hold digits and letters. Comments are read like code, as
    a secret in a comment is one, but give names no values. The last assignment
    in front of a use counts, and those further in (see ``Names``).
    """
    known = Names()
    out: set[tuple[int, int]] = set()
    seen, indent, remark = 0, *margin(text, 0)

    def assign(names: list[str], values: list[Constant]) -> None:
        whole = values[0]
        if len(values) > 1:
            whole = Constant()
            for v in values:
                whole.use(v)
        for name in () if remark else names:
            known.put(name, indent, whole)
        worth = max(map(name_score, names))
        if worth >= THRESHOLD:
            for v in values:
                if worth * v.score() >= THRESHOLD:
                    v.list_spans(out)

    def alone(name: str, start: int, end: int) -> None:
        if name_score(name) >= THRESHOLD:
            value = Constant()
            value.literal(text, start, end)
            if name_score(name) * value.score() >= THRESHOLD:
                value.list_spans(out)

    at, stop, over, gone = 0, -1, 0, 0
    while m := TARGET.search(text, at):
        heads = [(m["name"], m.end(), text[m.end() - 1] == "=")]
        while link := LINK.match(text, heads[-1][1]):
            heads.append((link["name"], link.end(), text[link.end() - 1] == "=" and not link["gap"]))
        at = heads[-1][1]
        line, seen = text.rfind("\n", seen, m.start()) + 1, m.start()
        if line:
            indent, remark = margin(text, line)
        values, end = quoted(text, at, known, indent)
        if values:
            at = end
            assign([name for name, _, _ in heads], values)
            continue
        # the targets of a chain with one unquoted value at its end; without white space they are part of the first value
        names: list[str] = []
        for k, (name, start, tight) in enumerate(heads):
            names.append(name)
            if start > stop:
                stop = STOP.search(text, start).start()
            if k + 1 < len(heads) and heads[k + 1][1] > stop:
                continue
            end = stop
            while end > start and text[end - 1] in ")]}" and not any(c in text[start:end] for c in "([{"):
                end -= 1
            # inside another unquoted value (a query string) only sensitive targets matter, and none whose value went already
            within = m.start() < over and (stop <= gone or max(map(name_score, names)) < THRESHOLD)
            if not within and end > start and (tight or TAIL.match(text, stop)) and not CODE.search(text[start:end]):
                value = Constant()
                value.literal(text, start, end)
                assign(names, [value])
                over, gone = stop, stop if value.listed else gone
            elif not remark:
                for x in names:
                    known.put(x, indent, None)
            break
    if "</" in text:
        for m in ELEMENT.finditer(text):
            raw = m["value"]
            if raw.strip():
                a = m.start("value") + len(raw) - len(raw.lstrip())
                if not any(c.isspace() for c in raw.strip()):
                    alone(m["name"], a, a + len(raw.strip()))
    for m in CALL.finditer(text):
        alone(m["name"], *inner(text, *m.span("value")))
    return sorted(out)


def scan_text(text: str | None) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of every secret of a text, sorted; null is empty."""
    if not text:
        return []
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "=" in text or ":" in text or "<" in text or "(" in text:
        found += [(a, 3, b) for a, b in lexed(text)]
    return sorted(set(found))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its id and ``spans`` array<struct<kind,start,end>>.

    Offsets are code points, the end exclusive; spans are sorted by start, then
    by kind, then by end. Null and empty texts get an empty array, very long
    texts are scanned whole, repeated rows give one row each, null ids stay null,
    an empty table gives no rows; other columns, whatever their names, are
    ignored. Narrow: no shuffle.
    """

    def rows(cols):
        ids, texts = cols
        return [ids, [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in scan_text(t)] for t in texts]]

    id_type = docs.select(id_col).schema[0].dataType.simpleString()
    return map_rows(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")),
        rows,
        f"id {id_type}, spans array<struct<kind:string,start:int,end:int>>",
    ).withColumnRenamed("id", id_col)


def values_of(text: str) -> list[tuple[int, int]]:
    """Disjoint intervals of the secret values themselves, without the names they are assigned to."""
    spans = [(a, b) for a, k, b in scan_text(text) if k]
    spans += [m.span(2) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def redact_text(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with each secret value replaced by ``mark``; other text is untouched."""
    spans = values_of(text) if text else []
    if not spans:
        return text
    parts, at = [], 0
    for a, b in spans:
        parts += [text[at:a], mark]
        at = b
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The same rows and columns with secrets masked; ``chars_col`` follows the new text where present.

    Null and empty texts, nulls in other columns and rows without secrets are
    unchanged; repeated rows change alike; an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    schema, at = docs.schema, docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = b.column(at).to_pylist()
            new = [redact_text(t) for t in texts]
            cols = list(b.columns)
            cols[at] = pa.array(new, type=b.schema.field(at).type)
            if chars_col in b.schema.names:
                k = b.schema.names.index(chars_col)
                old = b.column(k).to_pylist()
                cols[k] = pa.array(
                    [len(y) if x != y else o for x, y, o in zip(texts, new, old, strict=True)],
                    type=b.schema.field(k).type,
                )
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(run, schema)


def contract(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, and all spans as text, a row each of ``scan``.

    ``scan`` defines null, empty and long texts, ties, repeats, empty tables and further columns.
    """
    found = scan(docs)
    line = lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))
    base = F.filter("spans", lambda s: s.kind != "literal")
    count = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", line), ",").alias("spans"),
    )
