"""Operator 13 against scores of all pairs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tendermatch.llm import lexical_search as M
from tests.llm.conftest import rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(items, docs, top):
    own = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, n_terms = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in df}
    out = []
    for item, text in items:
        scored = []
        for d, c in own:
            m = 50 + 50 * sum(c.values()) * n_docs // n_terms
            score = sum(w[t] * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scored.append((-score, d is None, d))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, rank, d, -s) for rank, (s, _, d) in enumerate(scored[:top], 1)]
    return sorted(out, key=repr)


def made(seed, n_docs=300, n_items=25):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7)) % 90}" for _ in range(120)] + ["É", "中文", "The", "THE", "x\x7fy", "a_b", "½"]
    text = lambda n: rng.choice([" ", "  ", ", ", "\n"]).join(rng.choice(words) for _ in range(rng.randint(0, n)))
    docs = [(k, text(60)) for k in range(n_docs)]
    docs += [(n_docs + k, docs[7][1]) for k in range(20)] + [(None, docs[7][1]), (None, None), (5, docs[5][1]), (900, ""), (901, " .,\t")]
    items = [(k, text(12)) for k in range(n_items)] + [(3, docs[7][1]), (None, "w1 w2"), (50, None), (51, ""), (52, "unknown words"), (53, "w1")]
    return items, docs


def frames(spark, items, docs, parts=3):
    return (spark.createDataFrame(items, "item_id long, text string").repartition(2),
            spark.createDataFrame(docs, "doc_id long, text string").repartition(parts))


@pytest.mark.parametrize("seed,top,kw", [(1, 5, {}), (2, 1, {"leaf": 1, "fan": 2}), (3, 50, {"leaf": 3, "fan": 3}), (4, 1000, {"group_terms": 20})])
def test_equals_all_pairs(spark, seed, top, kw):
    items, docs = made(seed)
    assert rows(M.search(*frames(spark, items, docs), top=top, **kw)) == brute(items, docs, top)


def test_many_blocks_and_slices(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_DOCS", 7)
    monkeypatch.setattr(M, "SEED_BLOCKS", 2)
    monkeypatch.setattr(M, "SLICE", 9)
    items, docs = made(9)
    docs.append((77, "w1 w2 long " * 5_000))
    assert rows(M.search(*frames(spark, items, docs, 5), top=4, leaf=2, fan=2)) == brute(items, docs, 4)


def test_pruning_keeps_the_best_and_scores_few():
    """Documents and items in topics: most pairs are never scored, the best are those of all pairs."""
    rng = np.random.default_rng(0)
    n_docs, n_items, topics = 2000, 40, 20
    doc_terms = [np.unique(rng.integers(0, 30, 12) + 30 * (d % topics)) for d in range(n_docs)]
    item_terms = [np.unique(rng.integers(0, 30, 6) + 30 * (i % topics)) for i in range(n_items)]
    csr = lambda x: (np.cumsum([0, *map(len, x)]), np.concatenate(x))                                                # noqa: E731
    weights = rng.integers(500, 4000, 30 * topics)
    sizes = np.full(n_docs, 12)
    search = M.Search(*csr(item_terms), weights, n_docs, 12 * n_docs, np.zeros(n_items, dtype=np.int64), 10)
    starts, terms_ = csr(doc_terms)
    search.block(np.arange(n_docs), sizes, starts, terms_, np.ones(len(terms_), dtype=np.int64))
    item, doc, score = search.found()
    gain = 10**9 // (1000 + 20 * 100)
    for i in range(n_items):
        all_scores = [(-int(weights[np.intersect1d(item_terms[i], doc_terms[d])].sum()) * gain, d) for d in range(n_docs)]
        assert sorted(zip((-score[item == i]).tolist(), doc[item == i].tolist())) == sorted(all_scores)[:10]
    assert search.pairs < n_docs * n_items / 5


def test_no_rows_and_clashing_columns(spark):
    items, docs = made(5, 40, 5)
    i, d = frames(spark, items, docs)
    assert M.search(i, d.limit(0)).collect() == []
    assert M.search(i.limit(0), d).collect() == []
    clash = d.withColumn("score", F.lit("x")).withColumn("rank", F.lit(1)).withColumn("item_id", F.lit(2)).withColumn("ids", F.lit(0))
    wide = i.withColumn("doc_id", F.lit(1)).withColumn("row", F.lit(1)).withColumn("terms", F.lit(1)).withColumn("id", F.lit(1))
    assert rows(M.search(wide, clash, top=3)) == brute(items, docs, 3)
