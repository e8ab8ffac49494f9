"""Values, not only counts, on the tables with everything that may go wrong."""

import hashlib
from collections import Counter

import pytest

from prismalake.llm import html_text, mixing, ngram_join, passage_dedup, secret_scan, toxicity, warc_bundles

from . import messy
from .test_operators import WORD, base_spans, brute_components


def given(spark, name):
    return getattr(messy, name)(spark).collect()


def counted(rows):
    return Counter(map(repr, rows))


def test_mixing(spark):
    docs = given(spark, "documents")
    got = mixing.contract(messy.documents(spark)).collect()
    assert counted((r.doc_id, r.size) for r in got) == counted((r.doc_id, len(WORD.findall(r.text or ""))) for r in docs)
    sources = Counter()
    for r in docs:
        sources[r.source] += len(WORD.findall(r.text or ""))
    assert sum({r.target: 0 for r in got}) == pytest.approx(sum(sources.values()))
    for r in got:
        assert r.taken <= 3 * r.size and (r.position is None) == (r.taken == 0)
        assert r.position is None or 0 <= r.position <= (r.position_2 or 1) <= (r.position_3 or 1) <= 1


def test_warc(spark):
    pages = given(spark, "pages")
    body = {k: (r.html or "").encode() for k, r in enumerate(pages)}
    largest = {}
    for k, r in enumerate(pages):
        if len(body[k]) >= 1000 and r.page_id is not None:
            largest[body[k]] = max(largest.get(body[k], r.page_id), r.page_id)
    want = []
    for k, r in enumerate(pages):
        top = largest.get(body[k])
        again = r.page_id is not None and top is not None and r.page_id < top
        want.append((r.page_id, len(body[k]), hashlib.sha1(body[k]).hexdigest(), "revisit" if again else "response", top if again else None))
    assert counted(map(tuple, warc_bundles.contract(messy.pages(spark)).collect())) == counted(want)


def test_toxicity(spark):
    got = toxicity.contract(messy.documents(spark), messy.labels(spark)).collect()
    assert counted(r.doc_id for r in got) == counted(r.doc_id for r in given(spark, "documents"))
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(not r.held_out for r in got if r.doc_id is None)


def test_html(spark):
    got = html_text.contract(messy.pages(spark)).collect()
    want = [(r.page_id, r.url, t := html_text.main_text(r.html), len(t)) for r in given(spark, "pages")]
    assert counted(map(tuple, got)) == counted(want)
    assert {r.page_id: r.text for r in got}[6] == "plain < text & more" and {r.page_id: r.text for r in got}[3] == ""


def test_ngram_join(spark):
    docs = given(spark, "documents")
    sizes, comps = brute_components([r.text for r in docs])
    ids = [r.doc_id for r in docs]
    least = {}
    for i, c in zip(ids, comps):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = [(i, n, least.get(c) if n else i) for i, n, c in zip(ids, sizes, comps)]
    assert counted(map(tuple, ngram_join.contract(messy.documents(spark)).collect())) == counted(want)


def test_secrets(spark):
    want = []
    for r in given(spark, "documents"):
        spans = base_spans(r.text or "")
        text = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        want.append((r.doc_id, *(sum(k == x for _, k, _ in spans) for x in range(3)), hashlib.sha256(text.encode()).hexdigest()))
    got = secret_scan.contract(messy.documents(spark)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    assert counted(map(tuple, got.collect())) == counted(want)


def test_passages(spark):
    """A text of one word 30,000 times repeats itself, behind its first 50 words; the texts of 16 words stay."""
    got = passage_dedup.contract(messy.documents(spark)).collect()
    long = next(k for k, t in enumerate(messy.TEXTS) if t == messy.LONG)
    assert {r.doc_id for r in got} == {long}
    words = [m.span() for m in WORD.finditer(messy.LONG)]
    gone = [sum(any(r.start <= a and b <= r.end for r in got) for a, b in words)]
    assert gone[0] >= 30_000 - 100 and all(r.start >= words[50][0] for r in got)
    kept = {(r.doc_id, r.text): r for r in passage_dedup.dedup(messy.documents(spark)).collect()}
    assert all((r.doc_id, r.text) in kept for r in given(spark, "documents") if r.text != messy.LONG)
