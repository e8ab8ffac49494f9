"""The pipeline, stage by stage and against a plain version of all of it."""

import hashlib
from collections import defaultdict

import pytest

import corpus_pipeline
from prismalake.llm import decontaminate, ngram_join, secret_scan, toxicity

from . import messy
from .test_operators import WORD, brute_components, words_of


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == columns
        n = out.count()
        assert (n == before) if name == "secrets" else (0 < n <= before)
        docs, before = spark.createDataFrame(out.collect(), out.schema), n
    groups = ngram_join.join(docs)
    assert groups.filter("doc_id <> component_id").count() == 0
    assert decontaminate.overlaps(docs, spark.read.parquet(f"{data}/benchmark.parquet")).count() == 0
    assert secret_scan.contract(docs).filter("n_access + n_hex > 0").count() == 0


def leaks(text, items):
    w = words_of(text)
    for b in items:
        n = min(len(b), decontaminate.STRETCH)
        if len(b) < decontaminate.SPAN or len(w) < decontaminate.SPAN:
            continue
        for start in range(-len(b) + 1, len(w)):
            same = [0 <= start + j < len(w) and w[start + j] == x for j, x in enumerate(b)]
            if sum(same) >= 3 * n / 4 and max(sum(same[s : s + n]) for s in range(len(b) - n + 1)) >= -(-3 * n // 4):
                return True
    return False


def mixed(docs):
    """doc_id -> (size, target, taken) by resharing until no source is above its cap."""
    size = {i: len(WORD.findall(t)) for i, t, _ in docs}
    key = {i: hashlib.md5(f"{i}/{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest() for i, t, _ in docs}
    by = defaultdict(list)
    for i, _, s in docs:
        by[s].append(i)
    names = sorted(by)
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total = {s: sum(size[i] for i in by[s]) for s in names}
    target, open_, left = {}, set(names), float(sum(total.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 3 * total[s]}
        for s in over or open_:
            target[s] = 3.0 * total[s] if over else weight[s] * level
            left -= target[s] if over else 0
        open_ = open_ - over if over else set()
    out = {}
    for s in names:
        at, whole = 0, int(target[s] + 0.5)
        for i in sorted(by[s], key=key.get):
            taken = sum(max(0, min(size[i], whole - e * total[s] - at)) for e in range(3))
            out[i] = (size[i], target[s], taken)
            at += size[i]
    return out


def test_run_equals_a_plain_version(spark, data):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    lexicon = toxicity.train(spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet"))
    matcher = toxicity.Matcher(lexicon)
    docs = sorted(d for d in docs if matcher.score(d[1]) < 0.5)
    _, comps = brute_components([t for _, t, _ in docs])
    docs = [d for k, d in enumerate(docs) if comps[k] == k]
    items = [words_of(r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    docs = [d for d in docs if not leaks(d[1], items)]
    docs = [(i, secret_scan.redact_text(t), s) for i, t, s in docs]
    want = mixed(docs)
    got = {r.doc_id: (r.size, r.target, r.taken) for r in corpus_pipeline.run(spark, data).collect()}
    assert got.keys() == want.keys()
    for i, (size, target, taken) in want.items():
        assert got[i][0] == size and got[i][1] == pytest.approx(target) and got[i][2] == taken


@pytest.fixture(scope="module")
def messy_dir(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("messy"))
    for name in ("documents", "labels", "benchmark"):
        table = getattr(messy, name)(spark)
        table.write.parquet(f"{root}/full/{name}.parquet")
        table.limit(0).write.parquet(f"{root}/empty/{name}.parquet")
    return root


def plain_rows(df):
    return sorted(tuple("" if v is None else repr(v) for v in r) for r in df.collect())


def test_stages_on_messy_tables(spark, messy_dir):
    """What each stage has to keep of the messy rows, one after another."""
    docs = spark.read.parquet(f"{messy_dir}/full/documents.parquet")
    given = docs.collect()
    steps = dict(corpus_pipeline.STAGES)
    kept = steps["toxicity"](spark, docs, f"{messy_dir}/full")
    assert kept.columns == docs.columns and plain_rows(kept) == plain_rows(docs)  # three labels teach no term

    kept = steps["near duplicates"](spark, docs, f"{messy_dir}/full")
    want = {(r.doc_id, r.text) for r in given} - {(6, given[5].text)}  # the only two equal texts under different ids
    assert kept.columns == docs.columns
    assert sorted(map(repr, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(repr, want))

    kept = steps["decontamination"](spark, docs, f"{messy_dir}/full")
    assert kept.columns == docs.columns
    gone = {r.doc_id for r in given} - {r.doc_id for r in kept.collect()}
    assert gone == {5, 6} and kept.count() == len(given) - 2

    kept = steps["secrets"](spark, docs, f"{messy_dir}/full")
    assert kept.schema == docs.schema and kept.count() == len(given)
    for r in kept.collect():
        old = next(x for x in given if x.doc_id == r.doc_id and (x.text == r.text or x.doc_id in (9, 11)))
        assert r.text == secret_scan.redact_text(old.text)
        assert r.n_chars == (old.n_chars if r.text == old.text else len(r.text))

    got = steps["mixing"](spark, docs, f"{messy_dir}/full").collect()
    assert sorted((r.size for r in got)) == sorted(len(WORD.findall(r.text or "")) for r in given)


def test_run_on_messy_and_empty_tables(spark, messy_dir):
    got = corpus_pipeline.run(spark, f"{messy_dir}/full")
    assert got.count() > 5 and got.filter("taken > 3 * size").count() == 0
    docs = spark.read.parquet(f"{messy_dir}/empty/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, f"{messy_dir}/empty")
        assert out.count() == 0 and (name == "mixing" or out.columns == docs.columns)
        # rows without labels or benchmark
        assert stage(spark, spark.read.parquet(f"{messy_dir}/full/documents.parquet"), f"{messy_dir}/empty").count() > 0
    assert corpus_pipeline.run(spark, f"{messy_dir}/empty").count() == 0
