"""Ranking, splits, batches, metrics, jagged packing and export against brute force."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tendermatch.functions.text import clean_text
from tendermatch.functions.vectors import collapse_vectors, expand_vector
from tendermatch.functions.vectors import l2_normalize as V_l2
from tendermatch.operators import jagged as J
from tendermatch.operators import metrics as M
from tendermatch.operators.contracts import pk_violations
from tendermatch.operators.pairs import pair_features, split, with_batches
from tendermatch.operators.ranking import exact_quantiles, with_row_index
from tendermatch.operators.scoring import Layer, TowerWeights, apply_layers, tower_scores
from tendermatch.sources.export import typed_features, untyped


def test_row_index_is_global_and_partition_independent(spark):
    rng = np.random.default_rng(0)
    keys = rng.permutation(500).tolist()
    df = spark.createDataFrame([(int(k), int(k) % 3) for k in keys], "k long, g long").repartition(7)
    idx = {r.k: r.row_idx for r in with_row_index(df, ["k"], num_partitions=5).collect()}
    assert idx == {k: k for k in range(500)}
    grouped = {(r.g, r.k): r.row_idx for r in with_row_index(df, ["k"], group_by=["g"], num_partitions=4).collect()}
    for g in range(3):
        ks = sorted(k for k in range(500) if k % 3 == g)
        assert [grouped[(g, k)] for k in ks] == list(range(len(ks)))


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    vals = np.concatenate([rng.integers(0, 50, 300), np.full(200, 7)])   # one hot value: 40% of rows
    hist = (spark.createDataFrame([(float(v),) for v in vals], "value double")
            .groupBy("value").count().select(F.lit("x").alias("column"), "value", F.col("count").alias("cnt")))
    ps = [0.0, 0.005, 0.25, 0.5, 0.995, 1.0]
    got = exact_quantiles(hist, [("x", p) for p in ps])
    for p in ps:
        assert got[("x", p)] == pytest.approx(np.percentile(vals, p * 100))


def test_splits_cover_and_are_deterministic(spark):
    pairs = spark.range(1000).withColumnRenamed("id", "id")
    for mode, frac, n_test in (("head", 0.2, 200), ("random", 0.155, 155), ("id_range", 0.1, 100)):
        a = {r.id: r.split for r in split(pairs.repartition(3), frac, seed=5, mode=mode).collect()}
        b = {r.id: r.split for r in split(pairs.repartition(11), frac, seed=5, mode=mode).collect()}
        assert a == b and len(a) == 1000
        assert sum(v == "test" for v in a.values()) == n_test
    assert sum(r.split == "test" for r in split(pairs, 0.1555, seed=1, mode="random").collect()) == 156  # ceil
    assert all(r.split == "train" for r in split(pairs, 0.0).collect())


def test_batches_short_last(spark):
    b = with_batches(spark.range(10), ["id"], 4).orderBy("id").collect()
    assert [(r.batch_id, r.pos) for r in b] == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (1, 1), (1, 2), (1, 3),
                                                 (2, 0), (2, 1)]


def _torch_like(left, right, t, e):
    s = left @ right.T / t
    b = s.shape[0]

    def ce(m):
        lse = np.log(np.exp(m - m.max(1, keepdims=True)).sum(1)) + m.max(1)
        return np.mean((1 - e) * (lse - np.diag(m)) + e * (lse - m.mean(1)))
    loss = 0.5 * (ce(s) + ce(s.T))
    acc = np.mean(s.argmax(1) == np.arange(b))
    ranks = np.array([1 + np.sum(s[i] > s[i, i]) for i in range(b)])
    off = s[~np.eye(b, dtype=bool)]
    return {"loss": loss, "accuracy": acc, "mrr": np.mean(1 / ranks),
            "recall_at_5": np.mean(ranks <= min(5, b)), "neg": off.mean() if b > 1 else None,
            "cos": (np.sum(1 - np.sign(np.diag(s))) + np.sum(np.maximum(0, np.sign(off)))) / b / b}


def test_batch_metrics_match_numpy(spark):
    rng = np.random.default_rng(2)
    n, d, bsz = 23, 6, 8                       # last batch short (7 rows)
    left, right = rng.normal(size=(n, d)), rng.normal(size=(n, d))
    rows = [(i, left[i].tolist(), right[i].tolist()) for i in range(n)]
    pairs = spark.createDataFrame(rows, "pid long, l array<double>, r array<double>")
    batches = M.vector_batches(pairs, "l", "r", ["pid"], bsz)
    st = M.row_stats(batches, temperature=0.5)
    pb = {r.batch_id: r for r in M.per_batch(st, label_smoothing=0.1).collect()}
    cos = {r.batch_id: r.loss for r in M.batch_loss(st, "cosine_embedding").collect()}
    for b in range(3):
        sl = slice(b * bsz, min(n, (b + 1) * bsz))
        ref = _torch_like(left[sl], right[sl], 0.5, 0.1)
        assert pb[b].loss == pytest.approx(ref["loss"])
        assert pb[b].accuracy == pytest.approx(ref["accuracy"])
        assert pb[b].mrr == pytest.approx(ref["mrr"])
        assert pb[b].recall_at_5 == pytest.approx(ref["recall_at_5"])
        assert pb[b].negative_similarity_mean == pytest.approx(ref["neg"])
        assert cos[b] == pytest.approx(ref["cos"])
    top = M.top_k(batches, 20, 0.5).where("batch_id = 2").count()
    assert top == 7 * 7                        # k larger than the batch is clamped


@pytest.mark.parametrize("tile", [1, 3, 4096])
def test_cells_of_any_size_give_the_whole_matrix(spark, tile):
    """Batches cut into cells, with copies (ties across cells), a short batch and states merged by key."""
    rng = np.random.default_rng(5)
    left, right = rng.integers(-2, 3, size=(19, 4)) * 0.37, rng.integers(-2, 3, size=(19, 4)) * 0.11
    right[3], right[9], right[6], left[9] = right[0], right[0], right[2], left[0]
    rows = [(i, left[i].tolist(), right[i].tolist()) for i in range(19)]
    batches = M.vector_batches(spark.createDataFrame(rows, "pid long, l array<double>, r array<double>"), "l", "r", ["pid"], 12)
    st = {(r.batch_id, r.i): r for r in M.row_stats(batches, 0.5, tile=tile).collect()}
    sims = {(r.batch_id, r.i): r.sims for r in M.batch_similarity(batches, 0.5, tile=tile).collect()}
    top = {(r.batch_id, r.i, r["rank"]): (r.j, r.sim) for r in M.top_k(batches, 4, 0.5, tile=tile).collect()}
    for b, (lo, hi) in enumerate(((0, 12), (12, 19))):
        l, r = left[lo:hi], right[lo:hi]
        s = np.zeros((hi - lo, hi - lo))
        for k in range(4):                     # summed in the order of the dimensions
            s += np.outer(l[:, k], r[:, k])
        s /= 0.5
        for i in range(hi - lo):
            got, d = st[b, i], s[i, i]
            assert got.b == hi - lo and got.diag == d and got.row_max == s[i].max()
            assert got["rank"] == 1 + (s[i] > d).sum() + (s[i, :i] == d).sum()
            assert got.row_argmax == s[i].argmax() and got.col_argmax == s[:, i].argmax()
            want = [np.log(np.exp(s[i]).sum()), np.log(np.exp(s[:, i]).sum()), s[i].mean(), s[:, i].mean(), s[i].sum() - d, 1 - np.sign(d),
                    sum(s[i, j] > 0 for j in range(hi - lo) if j != i)]
            own = [got.row_lse, got.col_lse, got.row_mean, got.col_mean, got.off_sum, got.cos_pos, got.cos_neg]
            np.testing.assert_allclose(own, want, rtol=1e-9, atol=1e-12)
            np.testing.assert_allclose(sims[b, i], s[i], rtol=1e-9, atol=1e-12)
            order = sorted(range(hi - lo), key=lambda j: (-s[i, j], j))[:4]
            assert [top[b, i, k][0] for k in range(1, 5)] == order
    assert len(st) == len(sims) == 19 and len(top) == 19 * 4


def test_a_batch_beyond_one_cell(spark):
    """3,000 pairs in cells of 512: the identity matrix has every diagonal on top."""
    n = 3000
    v = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.cos(F.col("id") * (k + 1) / 100.0))
    unit = spark.range(n).select("id", V_l2(v).alias("l")).withColumn("r", F.col("l"))
    batches = M.vector_batches(unit, "l", "r", ["id"], n)
    st = M.row_stats(batches, 0.1, n, tile=512)
    out = M.alignment_check(st).first()
    assert out.diag_is_max > 0.9 and st.agg(F.min("b"), F.max("b"), F.count("*")).first() == (n, n, n)


def test_batch_of_one_has_null_negative_mean(spark):
    pairs = spark.createDataFrame([(0, [1.0, 0.0], [0.5, 0.5])], "pid long, l array<double>, r array<double>")
    st = M.row_stats(M.vector_batches(pairs, "l", "r", ["pid"], 4))
    r = M.batch_metrics(st).collect()[0]
    assert r.negative_similarity_mean is None and r.accuracy == 1.0


def test_tower_scores_match_numpy(spark):
    rng = np.random.default_rng(4)
    w = TowerWeights(dense=Layer(rng.normal(size=(3, 2)), rng.normal(size=2)),
                     embeddings=[rng.normal(size=(5, 2))],
                     mlp=[Layer(rng.normal(size=(4, 3)), np.zeros(3), relu=True,
                                bn=(np.ones(3) * 2, np.ones(3), np.zeros(3), np.ones(3) * 4, 0.0))],
                     final=Layer(rng.normal(size=(3, 2)), np.zeros(2)))
    x = rng.normal(size=(6, 3))
    cats = [0, 4, 9, -1, 2, 3]                  # out-of-range indices are clamped
    df = spark.createDataFrame([(i, x[i].tolist(), [cats[i]]) for i in range(6)], "id long, d array<double>, c array<long>")
    got = {r.id: np.array(r.embedding) for r in tower_scores(df, ["id"], "d", "c", w).collect()}
    emb = w.embeddings[0][np.clip(cats, 0, 4)]
    h = apply_layers(np.concatenate([apply_layers(x, [w.dense]), emb], axis=1), w.mlp)
    h = apply_layers(h, [w.final])
    h = h / np.linalg.norm(h, axis=1, keepdims=True)
    for i in range(6):
        np.testing.assert_allclose(got[i], h[i], rtol=1e-5, atol=1e-6)


def test_jagged_pack_unpack_roundtrip(spark):
    rows = [(i // 3, i % 3, [i, 10 + i]) for i in range(8)]
    df = spark.createDataFrame(rows, "batch_id long, pos int, categorical array<long>")
    packed = J.pack(df, ["k0", "k1"], layout="row_major")
    un = {(r.batch_id, r.row, r.key_pos): r.idx for r in J.unpack(packed).collect()}
    assert un == {(i // 3, i % 3, k): (i if k == 0 else 10 + i) for i in range(8) for k in range(2)}
    km = {r.batch_id: r.jagged["values"] for r in J.pack(df, ["k0", "k1"], layout="key_major").collect()}
    assert km[0] == [0, 1, 2, 10, 11, 12]
    multi = spark.createDataFrame([(0, 0, [1, 2], None), (0, 1, [], [5])],
                                  "batch_id long, pos int, a array<long>, b array<long>")
    j = J.pack_multi(multi, ["a", "b"]).collect()[0].jagged
    assert j["lengths"] == [2, 0, 0, 1] and j["values"] == [1, 2, 5]


def test_rows_of_a_batch_are_sorted_without_a_lambda(spark):
    df = spark.createDataFrame([(0, p, [p, -p]) for p in (5, 0, 3, 2, 4, 1)] + [(1, 0, [9, 9]), (None, 0, [7, 7])],
                               "batch_id long, pos int, categorical array<bigint>")
    packed = J.pack(df, ["a", "b"])
    assert {r.batch_id: r.jagged["values"] for r in packed.collect()} == {
        0: [v for p in range(6) for v in (p, -p)], 1: [9, 9], None: [7, 7]}
    plan = packed._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array(" in plan and "array_sort(" not in plan
    both = J.combine(packed.withColumn("g", F.lit(1)).withColumn("o", -F.coalesce("batch_id", F.lit(-1))), "g", "o")
    assert both.first().jagged["values"] == [9, 9, *[v for p in range(6) for v in (p, -p)], 7, 7]
    assert "array_sort(" not in both._jdf.queryExecution().optimizedPlan().toString()


def test_pk_violations_and_strict_pairs(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (2, "c")], "k long, v string")
    v = {(r.rule, r.k): r.n for r in pk_violations(df, ["k"]).collect()}
    assert v == {("duplicate", 1): 2, ("null", None): 1}
    pairs = spark.createDataFrame([(0, "n1", "c1"), (1, "n1", "c9")], "id long, notice_no string, bizno string")
    notices = spark.createDataFrame([("n1", 1.0)], "notice_no string, f double")
    comps = spark.createDataFrame([("c1", 2.0)], "bizno string, g double")
    with pytest.raises(Exception, match="missing from a feature store"):
        pair_features(pairs, notices, comps, ["notice_no"], ["bizno"], strict=True).collect()
    assert pair_features(pairs, notices, comps, ["notice_no"], ["bizno"], strict=False).count() == 1


def test_typed_features_rules(spark):
    df = spark.createDataFrame([(1, "[1, 2]", "[1.5, 2]", '["a", 1]', "[1,2", "[]", None, "plain", float("nan"), [0.5])],
                               "i long, a string, b string, c string, d string, e string, f string, g string, "
                               "h double, v array<float>")
    feats = typed_features(df).collect()[0].features
    assert feats["i"]["kind"] == "int64" and feats["i"]["ints"] == [1]
    assert feats["a"]["kind"] == "int64" and feats["a"]["ints"] == [1, 2]
    assert feats["b"]["kind"] == "float" and feats["b"]["floats"] == [1.5, 2.0]
    assert feats["c"]["kind"] == "bytes" and json.loads(feats["c"]["bytes"]) == ["a", 1]
    assert feats["d"]["kind"] == "bytes" and feats["d"]["bytes"] == "[1,2"
    assert "e" not in feats and "f" not in feats and "h" not in feats
    assert feats["g"]["bytes"] == "plain" and feats["v"]["kind"] == "float"
    out = typed_features(df).select(untyped(F.col("features")["i"]).alias("u")).collect()[0].u
    assert out == "1"


def test_text_clean_and_vector_collapse(spark):
    df = spark.createDataFrame([(1, "\t　 Hello World  "), (2, None)], "id long, t string")
    got = {r.id: r.c for r in df.select("id", clean_text("t").alias("c")).collect()}
    assert got == {1: "hello world", 2: ""}
    vec = spark.createDataFrame([(1, [1.0, 2.0]), (2, [float("nan"), 1.0])], "id long, e array<double>")
    back = {r.id: r.e for r in collapse_vectors(expand_vector(vec, "e", 2)).collect()}
    assert back == {1: [1.0, 2.0], 2: None}


def test_pandas_reference_percentile_interpolation():
    # the interpolation rule all quantile paths follow: v[lo] + (v[hi]-v[lo]) * frac
    v = pd.Series([1.0, 2.0, 4.0, 8.0])
    assert np.percentile(v, 50) == 3.0


def test_pages_come_in_order_at_any_depth(spark):
    from tendermatch.operators import lookups as L
    df = spark.range(300).withColumn("k", (F.col("id") * 7919) % 300).repartition(7)
    assert [r.k for r in L.page(df, ["k"], 40, 25).collect()] == list(range(40, 65))
    assert [r.k for r in L.page(df, ["k"], 295, 25).collect()] == list(range(295, 300))
    with pytest.raises(ValueError, match="lacks"):
        L.use_columns(df, ["k", "nothing"])


def test_weighted_running_total_of_groups(spark):
    from tendermatch.operators.ranking import with_running_total
    rng = np.random.default_rng(0)
    rows = [(f"g{int(g)}", float(v), int(c))
            for g, v, c in zip(rng.integers(0, 3, 300), rng.permutation(300), rng.integers(1, 5, 300))]
    df = spark.createDataFrame(rows, "k string, v double, c long")
    got = {(r.k, r.v): r.cum for r in with_running_total(df, ["v"], "c", group_by=["k"], name="cum").collect()}
    exp = {}
    for k in ("g0", "g1", "g2"):
        tot = 0
        for kk, v, c in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            tot += c
            exp[(kk, v)] = tot
    assert got == exp


def test_key_coverage_same_lineage_and_nulls(spark):
    from tendermatch.operators.joins import key_coverage
    base = spark.createDataFrame([(1,), (2,), (None,)], "k long")
    got = {(r.side, r.k) for r in key_coverage(base, base.where("k IS NULL OR k = 1"), ["k"]).collect()}
    assert got == {("missing", 2)}


def test_row_index_with_checkpointed_intermediates(spark):
    spark.conf.set("spark.tendermatch.materialize", "checkpoint")
    try:
        df = spark.range(100).select((F.col("id") * 37 % 100).alias("k"))
        idx = {r.k: r.row_idx for r in with_row_index(df, ["k"]).collect()}
    finally:
        spark.conf.unset("spark.tendermatch.materialize")
    assert idx == {k: k for k in range(100)}


def test_null_groups_keep_their_rows(spark):
    from tendermatch.operators.ranking import with_running_total
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("a", 4)], "g string, v long")
    assert {(r.g, r.v): r.row_idx for r in with_row_index(df, ["v"], group_by=["g"]).collect()} == {
        (None, 1): 0, (None, 2): 1, ("a", 3): 0, ("a", 4): 1}
    assert {(r.g, r.v): r.t for r in with_running_total(df, ["v"], "v", group_by=["g"], name="t").collect()} == {
        (None, 1): 1, (None, 2): 3, ("a", 3): 3, ("a", 4): 7}


def test_strict_pairs_fail_however_little_is_read(spark):
    pairs = spark.createDataFrame([(0, "n1", "c1"), (1, "n9", "c1")], "id long, notice_no string, bizno string")
    notices = spark.createDataFrame([("n1", 1.0)], "notice_no string, f double")
    comps = spark.createDataFrame([("c1", 2.0)], "bizno string, g double")
    out = pair_features(pairs, notices, comps, ["notice_no"], ["bizno"], strict=True)
    for read in (lambda: out.count(), lambda: out.select("g").collect(), lambda: out.select(F.lit(1)).collect()):
        with pytest.raises(Exception, match="missing from a feature store"):
            read()
    assert pair_features(pairs.where("id = 0"), notices, comps, ["notice_no"], ["bizno"]).count() == 1


def test_pair_keys_need_every_part(spark):
    from tendermatch.operators.pairs import pair_keys
    df = spark.createDataFrame([("a", None), (None, "d"), ("a", "b"), ("a", "b")], "x string, y string")
    assert [tuple(r) for r in pair_keys(df, ["x", "y"]).collect()] == [("a", "b")]


def test_missing_categories_embed_to_zeros(spark):
    from tendermatch.operators.scoring import embed_categorical
    df = spark.createDataFrame([(1, [0, 1]), (2, None), (3, []), (4, [None, 7]), (4, [1, 0])], "id long, c array<long>")
    tables = spark.createDataFrame([(0, 0, [1.0]), (0, 1, [2.0]), (1, 0, [3.0]), (1, 1, [4.0])], "key_pos int, idx long, vec array<double>")
    got = sorted((r.id, r.cat_embedding) for r in embed_categorical(df, ["id"], "c", tables, 1, 2).collect())
    assert got == [(1, [1.0, 4.0]), (2, [0.0, 0.0]), (3, [0.0, 0.0]), (4, [0.0, 0.0]), (4, [2.0, 3.0])]


def test_vectors_of_another_width_are_an_error(spark):
    from tendermatch.operators.scoring import project
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id long, v array<double>")
    with pytest.raises(Exception, match="width"):
        project(df, ["id"], "v", [Layer(np.eye(2), np.zeros(2))]).collect()


def test_typed_values_stay_exact(spark):
    from decimal import Decimal
    df = spark.createDataFrame([("[9007199254740993]", "[1, true]", "[false]", '["true", 1]', Decimal("1.50"), [True, False])],
                               "a string, b string, c string, d string, e decimal(10,2), f array<boolean>")
    feats = typed_features(df).collect()[0].features
    assert feats["a"]["ints"] == [9007199254740993] and feats["b"]["ints"] == [1, 1] and feats["c"]["ints"] == [0]
    assert feats["d"]["bytes"] == '["true", 1]' and feats["e"]["kind"] == "bytes" and feats["e"]["bytes"] == "1.50"
    assert feats["f"]["ints"] == [1, 0]


def test_search_compares_typed_values(spark):
    from tendermatch.sources.export import search
    df = spark.createDataFrame([(1, 5, "5"), (2, 6, "5")], "rec_no long, n long, s string")
    recs = typed_features(df, ("rec_no",))
    assert [r.rec_no for r in search(recs, "n", 5).collect()] == [1] and search(recs, "n", "5").count() == 0
    assert [r.rec_no for r in search(recs, "s", "5").collect()] == [1, 2] and search(recs, "s", 5).count() == 0


def test_merge_one_to_one(spark):
    from tendermatch.operators.joins import merge_one_to_one
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k long, v string")
    b = spark.createDataFrame([(1, 1.0), (None, 3.0), (5, 9.0)], "k long, w double")
    assert sorted(map(tuple, merge_one_to_one(a, b, ["k"]).collect()), key=repr) == [(1, "x", 1.0), (2, "y", None), (None, "z", 3.0)]
    for left, right, side in ((a.union(a), b, "left"), (a, b.union(b), "right")):
        with pytest.raises(ValueError, match=f"{side} side"):
            merge_one_to_one(left, right, ["k"])
