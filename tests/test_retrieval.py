"""Whole-corpus top-k against all pairs; vectors evaluated once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tendermatch.functions import vectors as V
from tendermatch.functions.text import hashed_embedding
from tendermatch.operators.retrieval import corpus_topk
from tendermatch.operators.text import text_transform


def frames(spark, q, x):
    rows = lambda m: [(k, None if v is None else [float(f) for f in v]) for k, v in enumerate(m)]     # noqa: E731
    return (spark.createDataFrame(rows(q), "a long, v array<double>").repartition(3),
            spark.createDataFrame(rows(x), "b long, w array<double>").repartition(2))


def brute(q, x, k):
    def usable(v):
        return v is not None and len(v) and np.isfinite(v).all()
    out = []
    for a, u in enumerate(q):
        if usable(u):
            scores = sorted((-sum(float(p) * float(r) for p, r in zip(u, w)), b) for b, w in enumerate(x) if usable(w))
            out += [(a, b, rank, -s) for rank, (s, b) in enumerate(scores[:k], 1)]
    return out


def got(spark, q, x, k, **kw):
    t = corpus_topk(*frames(spark, q, x), ["a"], ["b"], "v", "w", k, **kw)
    return [tuple(r) for r in t.orderBy("a", "rank").collect()]


def test_equals_all_pairs_with_clusters_lengths_and_copies(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(6, 5))
    x = [centres[k % 6] * (1 + k % 3) + rng.normal(size=5) * 0.05 for k in range(90)]
    x += [x[4].copy() for _ in range(60)] + [np.zeros(5), None, np.array([1.0, np.nan, 0, 0, 0]), np.array([np.inf, 0, 0, 0, 0])]
    q = [centres[k % 6] + rng.normal(size=5) * 0.1 for k in range(40)] + [np.zeros(5), x[4].copy(), None, -centres[0]]
    for k, kw in ((1, {}), (7, {"block_rows": 8, "pivots": 4, "pack_rows": 5}), (200, {"block_rows": 16, "pivots": 3})):
        own, want = got(spark, q, x, k, **kw), brute(q, x, k)
        assert [r[:3] for r in own] == [r[:3] for r in want]
        np.testing.assert_allclose([r[3] for r in own], [r[3] for r in want], rtol=1e-9, atol=1e-12)


def test_no_rows_and_errors(spark):
    assert got(spark, [np.ones(2)], [None], 3) == []
    assert got(spark, [None], [np.ones(2)], 3) == []
    with pytest.raises(ValueError):
        corpus_topk(*frames(spark, [np.ones(2)], [np.ones(2)]), ["a"], ["a"], "v", "w", 3)
    with pytest.raises(Exception, match="width"):
        got(spark, [np.ones(2)], [np.ones(3)], 3)


def test_blocks_out_of_reach_are_not_visited(spark):
    """Far clusters: only a few (query, block) visits, far fewer than all pairs of them."""
    rng = np.random.default_rng(1)
    centres = np.eye(8) * 50
    x = [centres[k % 8] + rng.normal(size=8) * 0.01 for k in range(400)]
    q = [centres[k % 8] + rng.normal(size=8) * 0.01 for k in range(80)]
    t = corpus_topk(*frames(spark, q, x), ["a"], ["b"], "v", "w", 5, block_rows=10, pivots=16)
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert [tuple(r)[:3] for r in t.orderBy("a", "rank").collect()] == [r[:3] for r in brute(q, x, 5)]


def test_copies_are_compared_once(spark, monkeypatch):
    """Few distinct vectors on both sides: what is compared grows with them and not with all pairs of rows."""
    from tendermatch.operators import retrieval

    seen = []
    blocks = retrieval._blocks
    monkeypatch.setattr(retrieval, "_blocks", lambda items, *rest: (seen.append(items.count()), blocks(items, *rest))[1])
    x = [np.array(v, dtype=float) for v in ((1, 1), (1, -1), (0, 0), (-0.0, 0))] * 100 + [None]
    q = [np.array(v, dtype=float) for v in ((2, 1), (0, 0), (-1, 3))] * 50 + [np.array([np.nan, 1])]
    own, want = got(spark, q, x, 6, block_rows=8, pivots=4, pack_rows=7), brute(q, x, 6)
    assert [r[:3] for r in own] == [r[:3] for r in want] and [r[3] for r in own] == [r[3] for r in want]
    assert seen == [18]                                                  # 3 vectors (zero has one sign), 6 items each


def optimised(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_an_exploded_text_vector_is_hashed_once(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, ""), (3, None)], "doc_id int, text string")
    vec = text_transform(docs, ["doc_id"], {"text": {"l2_normalize": True}})
    assert optimised(V.explode_vector(vec, ["doc_id"], "text")).count("md5(") == 1
    assert optimised(V.explode_vector(hashed_embedding(docs, "text"), ["doc_id"], "text")).count("md5(") == 1
    assert V.explode_vector(vec, ["doc_id"], "text").count() == 24


def test_a_normalised_vector_has_one_norm(spark):
    e = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [])], "id int, v array<double>")
    unit = e.select("id", V.l2_normalize("v").alias("v"))
    assert optimised(V.explode_vector(unit, ["id"], "v")).upper().count("SQRT(") == 1
    assert [tuple(r) for r in V.explode_vector(unit, ["id"], "v").orderBy("id", "pos").collect()] == [(1, 0, 0.6), (1, 1, 0.8), (2, 0, 0.0), (2, 1, 0.0)]
    assert {r.id: r.v for r in unit.collect()} == {1: [0.6, 0.8], 2: [0.0, 0.0], 3: None, 4: []}


def test_wide_hashed_embedding(spark):
    """Dimensions beyond the first 32 come from further hashes; a token of each block is hashed once."""
    docs = spark.createDataFrame([(1, "x y x"), (2, " ")], "doc_id int, text string")
    out = {r.doc_id: r.text for r in hashed_embedding(docs, "text", 40).collect()}
    import hashlib
    def digit(tok, k):
        text = tok if k < 32 else f"{tok}#{k // 32}"
        return int(hashlib.md5(text.encode()).hexdigest()[k % 32], 16)
    want = [(sum(digit(t, k) for t in "xyx") - 22.5) / 7.5 / 3 for k in range(40)]
    np.testing.assert_allclose(out[1], want, rtol=1e-9, atol=1e-12)
    assert out[2] == [0.0] * 40
