"""Benchmark the headline queries.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query runs to completion through the ``noop`` sink (full execution, no
collect). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tendermatch.plans.registry import QUERIES, load_all  # noqa: E402
from tendermatch.session import build_session, release_pinned  # noqa: E402

HEADLINE = [
    "numeric_transform",        # numeric fit (exact quantiles) + transform
    "categorical_encode",       # vocabulary fit + lookup joins
    "features_merged",          # full preprocessing of the notice table
    "pair_features",            # pairs joined to both sides' features
    "split_random",             # seeded hash shuffle + distributed rank
    "eval_summary",             # in-batch similarity -> loss / recall / MRR
    "text_embed",               # whole-text clean + hashed-token pooling
    "typed_features",           # typed feature export
    "jagged_pack_row_major",    # batches -> jagged packing
    "column_profile",           # value counts per column
    "training_batches",         # pairs joined to both sides' features, shuffled, batched, collated
    "pair_scores",              # both towers, dot product per pair
]


def _sf_value(sf_dir: str):
    tag = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    try:
        return float(tag)
    except ValueError:
        return tag


def score_all_pairs(spark, sf_dir: str) -> int:
    """Both towers over every pair, batches of 50, all similarities of a batch, averaged metrics; the number of pairs."""
    from tendermatch.operators import metrics as M
    from tendermatch.plans import roles
    from tendermatch.plans.store_queries import company_embeddings, notice_embeddings

    notices = notice_embeddings(spark, sf_dir).withColumnRenamed("embedding", "left")
    companies = company_embeddings(spark, sf_dir).withColumnRenamed("embedding", "right")
    pairs = roles.pairs(spark, sf_dir).join(notices, roles.NOTICE_PK).join(companies, roles.COMPANY_PK)
    stats = M.row_stats(M.vector_batches(pairs, "left", "right", ["id"], 50), 0.1)
    M.evaluate(stats, 0.1).collect()
    return roles.pairs(spark, sf_dir).count()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(8, cpus * 2),
                          extra={"spark.driver.memory": "16g"})
    load_all()
    # Warm-up, not timed: the same plans once on the smallest fixture, so the
    # timed runs measure steady state (JIT-compiled JVM, cached generated code,
    # started Python workers) rather than one-off compilation.
    warm = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm):
        for name in HEADLINE:
            QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
            release_pinned()
    QUERIES["row_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        release_pinned()             # each query starts without the previous one's pinned intermediates
    from tendermatch.operators.categorical import categorical_fit
    from tendermatch.operators.numeric import numeric_fit
    from tendermatch.plans import roles
    from tendermatch.plans.pipeline import FittedPipeline, preprocess
    notice = roles.notice(spark, sf_dir)
    t0 = time.perf_counter()
    num = numeric_fit(notice.select(*roles.NOTICE_PK, *roles.NOTICE_NUMERIC), roles.NOTICE_NUMERIC, roles.NOTICE_PK)
    t_num = time.perf_counter() - t0
    t0 = time.perf_counter()
    cat = categorical_fit(notice.select(*roles.NOTICE_PK, *roles.NOTICE_CATEGORICAL), roles.NOTICE_CATEGORICAL,
                          roles.NOTICE_PK)
    cat.lookup.count()                       # materialise the lookup the transform broadcasts
    t_cat = time.perf_counter() - t0
    t0 = time.perf_counter()
    preprocess(notice, FittedPipeline(roles.NOTICE_PK, num, cat, {})).write.format("noop").mode("overwrite").save()
    t_tr = time.perf_counter() - t0
    release_pinned()
    # all positive pairs of the scale factor scored in batches of 50: similarity of every pair of a batch, loss, recall, MRR
    t0 = time.perf_counter()
    n_eval = score_all_pairs(spark, sf_dir)
    t_eval = time.perf_counter() - t0
    release_pinned()
    rows = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("orders", "lineitem", "embeddings")}
    n_pairs = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_suppkey").distinct().count()
    throughput = {
        "numeric_fit_s": round(t_num, 3), "categorical_fit_s": round(t_cat, 3),
        "transform_rows_per_s": round(rows["orders"] / t_tr, 1),
        "notice_preprocess_rows_per_s": round(rows["orders"] / times["features_merged"], 1),   # fit + transform
        "pair_feature_rows_per_s": round(n_pairs / times["pair_features"], 1),
        "training_pairs_per_s": round(n_pairs / times["training_batches"], 1),
        "scored_pairs_per_s": round(n_pairs / times["pair_scores"], 1),
        "eval_pairs_per_s": round(n_eval / t_eval, 1),                       # batch 50
        "eval_similarity_cells_per_s": round(n_eval * 50 / t_eval, 1),
    }
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": _sf_value(sf_dir),
                      "throughput": throughput}))
    spark.stop()


if __name__ == "__main__":
    main()
