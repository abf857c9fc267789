"""Similarity, loss and retrieval-metric queries over embedding pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tendermatch.functions.numeric import round6
from tendermatch.operators import metrics as M
from tendermatch.plans import roles
from tendermatch.plans.registry import query
from tendermatch.plans.sqlparts import VPAIR_CTE, r6, with_

# Fixed evaluation settings of these queries.
BATCH = 50
TEMPERATURE = 0.1
SMOOTHING = 0.1

STATS_CTE = f"""vb AS (SELECT pair_id, left_vec, right_vec, row_number() OVER (ORDER BY pair_id) - 1 AS rk FROM vpair),
vb2 AS (SELECT rk // {BATCH} AS batch_id, CAST(rk % {BATCH} AS INTEGER) AS i,
               CAST(left_vec AS DOUBLE[]) AS lv, CAST(right_vec AS DOUBLE[]) AS rv FROM vb),
sim AS (SELECT a.batch_id, a.i, b.i AS j, list_inner_product(a.lv, b.rv) / {TEMPERATURE} AS s
        FROM vb2 a JOIN vb2 b ON a.batch_id = b.batch_id),
bs AS (SELECT batch_id, count(*) AS b FROM vb2 GROUP BY batch_id),
dg AS (SELECT batch_id, i, s AS d FROM sim WHERE i = j),
rm AS (SELECT batch_id, i, max(s) AS mx, avg(s) AS mean FROM sim GROUP BY batch_id, i),
cm AS (SELECT batch_id, j AS i, max(s) AS mx, avg(s) AS mean FROM sim GROUP BY batch_id, j),
rowagg AS (SELECT s.batch_id, s.i, rm.mx + ln(sum(exp(s.s - rm.mx))) AS row_lse, rm.mean AS row_mean,
                  rm.mx AS row_max, min(CASE WHEN s.s = rm.mx THEN s.j END) AS row_argmax,
                  1 + sum(CASE WHEN s.s > dg.d OR (s.s = dg.d AND s.j < s.i) THEN 1 ELSE 0 END) AS rank,
                  sum(CASE WHEN s.j <> s.i THEN s.s ELSE 0 END) AS off_sum,
                  sum(CASE WHEN s.j <> s.i AND s.s > 0 THEN 1.0 ELSE 0.0 END) AS cos_neg
           FROM sim s JOIN rm USING (batch_id, i) JOIN dg USING (batch_id, i)
           GROUP BY s.batch_id, s.i, rm.mx, rm.mean),
colagg AS (SELECT s.batch_id, s.j AS i, cm.mx + ln(sum(exp(s.s - cm.mx))) AS col_lse, cm.mean AS col_mean,
                  min(CASE WHEN s.s = cm.mx THEN s.i END) AS col_argmax
           FROM sim s JOIN cm ON cm.batch_id = s.batch_id AND cm.i = s.j GROUP BY s.batch_id, s.j, cm.mx, cm.mean),
st AS (SELECT r.*, c.col_lse, c.col_mean, c.col_argmax, dg.d AS diag, bs.b, 1.0 - sign(dg.d) AS cos_pos
       FROM rowagg r JOIN colagg c USING (batch_id, i) JOIN dg USING (batch_id, i) JOIN bs USING (batch_id)),
loss AS (SELECT batch_id, 0.5 * (avg((1 - {SMOOTHING}) * (row_lse - diag) + {SMOOTHING} * (row_lse - row_mean))
                              + avg((1 - {SMOOTHING}) * (col_lse - diag) + {SMOOTHING} * (col_lse - col_mean))) AS loss
         FROM st GROUP BY batch_id),
bm AS (SELECT batch_id, avg(CASE WHEN row_argmax = i THEN 1.0 ELSE 0.0 END) AS accuracy,
              avg(diag) AS pos, CASE WHEN max(b) > 1 THEN sum(off_sum) / (max(b) * max(b) - max(b)) END AS neg,
              avg(CASE WHEN rank <= least(5, b) THEN 1.0 ELSE 0.0 END) AS r5,
              avg(CASE WHEN rank <= least(10, b) THEN 1.0 ELSE 0.0 END) AS r10,
              avg(1.0 / rank) AS mrr
       FROM st GROUP BY batch_id)"""


def _stats(spark, sf_dir):
    b = M.vector_batches(roles.vector_pairs(spark, sf_dir), "left_vec", "right_vec", ["pair_id"], BATCH)
    return b, M.row_stats(b, TEMPERATURE, BATCH)


@query("batch_similarity", oracle=with_(VPAIR_CTE, STATS_CTE) + """
SELECT CAST(batch_id AS BIGINT) AS batch_id, i, list(round(s, 6) + 0.0 ORDER BY j) AS sims
FROM sim GROUP BY batch_id, i""")
def batch_similarity_q(spark, sf_dir):
    b, _ = _stats(spark, sf_dir)
    s = M.batch_similarity(b, TEMPERATURE, BATCH)
    return s.select("batch_id", "i", F.transform("sims", lambda x: F.round(x, 6) + F.lit(0.0)).alias("sims"))


@query("batch_loss_ce", oracle=with_(VPAIR_CTE, STATS_CTE) + f"""
SELECT CAST(batch_id AS BIGINT) AS batch_id, {r6('loss')} AS loss FROM loss""")
def batch_loss_ce_q(spark, sf_dir):
    _, st = _stats(spark, sf_dir)
    return M.batch_loss(st, "cross_entropy", SMOOTHING).select("batch_id", round6("loss").alias("loss"))


@query("batch_loss_cosine", oracle=with_(VPAIR_CTE, STATS_CTE) + f"""
SELECT CAST(batch_id AS BIGINT) AS batch_id, {r6('(sum(cos_pos) + sum(cos_neg)) / (max(b) * max(b))')} AS loss
FROM st GROUP BY batch_id""")
def batch_loss_cosine_q(spark, sf_dir):
    _, st = _stats(spark, sf_dir)
    return M.batch_loss(st, "cosine_embedding").select("batch_id", round6("loss").alias("loss"))


@query("batch_metrics", oracle=with_(VPAIR_CTE, STATS_CTE) + f"""
SELECT CAST(batch_id AS BIGINT) AS batch_id, {r6('accuracy')} AS accuracy, {r6('pos')} AS positive_similarity_mean,
       {r6('neg')} AS negative_similarity_mean, {r6('pos - neg')} AS similarity_gap FROM bm""")
def batch_metrics_q(spark, sf_dir):
    _, st = _stats(spark, sf_dir)
    m = M.batch_metrics(st)
    return m.select("batch_id", *[round6(c).alias(c) for c in ("accuracy", "positive_similarity_mean",
                                                               "negative_similarity_mean", "similarity_gap")])


@query("batch_recall_mrr", oracle=with_(VPAIR_CTE, STATS_CTE) + f"""
SELECT CAST(batch_id AS BIGINT) AS batch_id, {r6('r5')} AS recall_at_5, {r6('r10')} AS recall_at_10,
       {r6('mrr')} AS mrr FROM bm""")
def batch_recall_mrr_q(spark, sf_dir):
    _, st = _stats(spark, sf_dir)
    m = M.recall_mrr(st, (5, 10))
    return m.select("batch_id", *[round6(c).alias(c) for c in ("recall_at_5", "recall_at_10", "mrr")])


@query("batch_alignment", oracle=with_(VPAIR_CTE, STATS_CTE) + f"""
, al AS (SELECT batch_id, avg(CASE WHEN row_argmax = i THEN 1.0 ELSE 0.0 END) AS row_hit,
                avg(CASE WHEN col_argmax = i THEN 1.0 ELSE 0.0 END) AS col_hit,
                avg(CASE WHEN diag = row_max THEN 1.0 ELSE 0.0 END) AS diag_is_max FROM st GROUP BY batch_id)
SELECT CAST(batch_id AS BIGINT) AS batch_id, {r6('row_hit')} AS row_hit, {r6('col_hit')} AS col_hit,
       {r6('diag_is_max')} AS diag_is_max,
       CASE WHEN row_hit < 0.05 AND col_hit < 0.05 THEN 'critical'
            WHEN row_hit < 0.3 OR col_hit < 0.3 THEN 'warning' ELSE 'ok' END AS status FROM al""")
def batch_alignment_q(spark, sf_dir):
    _, st = _stats(spark, sf_dir)
    a = M.alignment_check(st)
    return a.select("batch_id", *[round6(c).alias(c) for c in ("row_hit", "col_hit", "diag_is_max")], "status")


@query("batch_topk", oracle=with_(VPAIR_CTE, STATS_CTE) + f"""
, ranked AS (SELECT batch_id, i, j, s, row_number() OVER (PARTITION BY batch_id, i ORDER BY s DESC, j) AS rank
             FROM sim)
SELECT CAST(batch_id AS BIGINT) AS batch_id, i, j, {r6('s')} AS sim, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE rank <= 5""")
def batch_topk_q(spark, sf_dir):
    b, _ = _stats(spark, sf_dir)
    t = M.top_k(b, 5, TEMPERATURE, BATCH)
    return t.select("batch_id", "i", "j", round6("sim").alias("sim"), "rank")


_EVAL_COLS = ["loss", "accuracy", "recall_at_5", "recall_at_10", "mrr", "similarity_gap"]


@query("eval_summary", oracle=with_(VPAIR_CTE, STATS_CTE) + f"""
, pb AS (SELECT l.batch_id, l.loss, bm.accuracy, bm.r5, bm.r10, bm.mrr, bm.pos - bm.neg AS gap, bm.neg
         FROM loss l JOIN bm USING (batch_id)),
ev AS (SELECT avg(loss) AS loss, avg(accuracy) AS accuracy, avg(r5) AS r5, avg(r10) AS r10, avg(mrr) AS mrr,
              avg(gap) AS gap, avg(neg) AS neg, count(*) AS nb FROM pb)
SELECT {r6('loss')} AS loss, {r6('accuracy')} AS accuracy, {r6('r5')} AS recall_at_5, {r6('r10')} AS recall_at_10,
       {r6('mrr')} AS mrr, {r6('gap')} AS similarity_gap, CAST(nb AS BIGINT) AS num_batches,
       {r6(f'1.0 / {BATCH}')} AS random_accuracy, accuracy > 1.0 / {BATCH} AS accuracy_improvement,
       r5 > least(5.0 / {BATCH}, 1.0) AS recall_at_5_improvement,
       r10 > least(10.0 / {BATCH}, 1.0) AS recall_at_10_improvement,
       CASE WHEN accuracy > 0.3 THEN 'good' WHEN accuracy > 0.15 THEN 'fair' ELSE 'poor' END AS accuracy_level,
       CASE WHEN r10 > 0.6 THEN 'practical' WHEN r10 > 0.4 THEN 'needs_work' ELSE 'insufficient' END AS recall_level,
       CASE WHEN gap > 0.5 THEN 'good' ELSE 'needs_work' END AS gap_level,
       {r6('gap / greatest(abs(neg) + 1e-8, 1e-8)')} AS z_gap
FROM ev""")
def eval_summary_q(spark, sf_dir):
    _, st = _stats(spark, sf_dir)
    ev = M.with_z_gap(M.assess(M.compare_to_random(M.evaluate(st, SMOOTHING, (5, 10)), BATCH, (5, 10))))
    return ev.select(*[round6(c).alias(c) for c in _EVAL_COLS], F.col("num_batches").cast("long"),
                     round6("random_accuracy").alias("random_accuracy"), "accuracy_improvement",
                     "recall_at_5_improvement", "recall_at_10_improvement", "accuracy_level", "recall_level",
                     "gap_level", round6("z_gap").alias("z_gap"))


@query("best_epoch", oracle=with_(VPAIR_CTE, STATS_CTE) + f"""
SELECT CAST(batch_id AS BIGINT) AS batch_id, {r6('loss')} AS loss FROM loss ORDER BY loss, batch_id LIMIT 1""")
def best_epoch_q(spark, sf_dir):
    # the per-batch evaluation plays the run log: lowest loss, earliest batch on ties
    _, st = _stats(spark, sf_dir)
    best = M.best_epoch(M.batch_loss(st, "cross_entropy", SMOOTHING), "loss", "batch_id")
    return best.select("batch_id", round6("loss").alias("loss"))


@query("corpus_topk", oracle=with_(VPAIR_CTE) + f"""
, sc AS (SELECT q.pair_id, i.pair_id AS match_id, list_inner_product(CAST(q.left_vec AS DOUBLE[]), CAST(i.right_vec AS DOUBLE[])) AS s
         FROM vpair q CROSS JOIN vpair i),
ranked AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY s DESC, match_id) AS rank FROM sc)
SELECT pair_id, match_id, CAST(rank AS INTEGER) AS rank, {r6('s')} AS score FROM ranked WHERE rank <= 10""")
def corpus_topk_q(spark, sf_dir):
    """The ten right vectors of the highest inner product for every left vector, over all of them."""
    from tendermatch.operators.retrieval import corpus_topk
    p = roles.vector_pairs(spark, sf_dir)
    t = corpus_topk(p.select("pair_id", "left_vec"), p.select(F.col("pair_id").alias("match_id"), "right_vec"), ["pair_id"], ["match_id"],
                    "left_vec", "right_vec", 10)
    return t.select("pair_id", "match_id", "rank", round6("score").alias("score"))
