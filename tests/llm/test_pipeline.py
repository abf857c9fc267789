"""The pipeline's stages on a small table, each against its own input."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tendermatch.llm.common import pin

from .test_lines_urls_exact import _key
from .test_near_mix_lm import multiset, roots, similarity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    tables = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(pin(stage(spark, tables[-1], SF), "test-stage"))
    return tables


def test_columns(steps):
    assert len(corpus_pipeline.STAGES) == 5
    for table in steps[:-1]:
        assert table.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_keeps_labelled_good_documents(spark, steps):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in steps[1].collect()}
    good = [i in kept for i, q in labels.items() if q == 1]
    bad = [i in kept for i, q in labels.items() if q == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.1


def test_lines(steps):
    before, after = ({r.doc_id: r.text for r in t.collect()} for t in steps[1:3])
    holders = defaultdict(set)
    for i, t in before.items():
        for line in t.split("\n"):
            holders[_key(line)].add(i)
    for i, t in before.items():
        assert after[i] == "\n".join(x for x in t.split("\n") if len(_key(x)) < 10 or min(holders[_key(x)]) == i)
    assert len(after) == len(before)


def test_one_of_each_group_of_near_copies(steps):
    before, after = steps[2].collect(), {r.doc_id for r in steps[3].collect()}
    sets = [(r.doc_id, multiset(r.text)) for r in before]
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[k + 1:] if x and y and similarity(x, y) >= 0.8]
    up = roots([i for i, _ in sets], links)
    assert after == {i for i in up if up[i] == i}


def test_mix_and_ids(steps):
    before, after = {r.doc_id: r for r in steps[3].collect()}, steps[4].collect()
    assert all(r == before[r.doc_id] for r in after) and max(Counter(r.doc_id for r in after).values()) <= 2
    coded = steps[5].collect()
    assert Counter(r.doc_id for r in coded) == Counter(r.doc_id for r in after)
    for r in coded:
        assert r.decoded_sha256 == hashlib.sha256((before[r.doc_id].text or "").encode()).hexdigest() and len(r.ids) == r.n_tokens


def test_run_is_the_stages(spark, steps):
    key = lambda t: sorted((r.doc_id, r.ids_sha256) for r in t.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(steps[-1])


def test_stages_take_an_empty_table(spark):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
