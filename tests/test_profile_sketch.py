"""Profiles that add up: errors as stated."""

import numpy as np
from pyspark.sql import functions as F

from tendermatch.operators import profile_sketch as S


def test_merged_profiles_keep_their_errors(spark):
    rng = np.random.default_rng(0)
    n = 20_000
    zipf = np.minimum(rng.zipf(1.3, n), 5000)
    df = spark.createDataFrame([(int(i), f"v{z}", None if i % 10 == 0 else "one") for i, z in enumerate(zipf)], "id long, z string, o string").repartition(4)
    heavy = 20
    parts = [S.profile_state(df.where(F.col("id") % 5 == k), heavy=heavy) for k in range(5)]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    state = S.merge_profiles(merged, heavy).persist()
    est = {r["column"]: r for r in S.profile_estimate(state).collect()}
    true = {"id": n, "z": len(set(zipf)), "o": 1}
    for c, d in true.items():
        assert est[c].n_rows == n and abs(est[c].n_distinct - d) <= max(2, 0.06 * d)
    assert est["o"].n_null == n // 10 and est["id"].n_null == 0
    lost = {r["column"]: r.lost for r in state.collect()}
    assert all(0 <= v <= n / (heavy + 1) for v in lost.values()) and lost["o"] == 0
    values, counts = np.unique(zipf, return_counts=True)
    exact = {f"v{v}": c for v, c in zip(values, counts)}
    share = 0.05
    found = {r.value: r for r in S.frequent_values(state, share).where("column = 'z'").collect()}
    assert {v for v, c in exact.items() if c >= share * n} <= set(found)
    assert all(r.at_least <= exact[v] <= r.at_most for v, r in found.items())
    assert [(r.value, r.at_least) for r in S.frequent_values(state, 0.5).where("column = 'o'").collect()] == [("one", n - n // 10)]


def test_no_rows_and_null_columns(spark):
    df = spark.createDataFrame([(None, "a")], "x int, y string")
    est = {r["column"]: (r.n_rows, r.n_null, r.n_distinct) for r in S.profile_estimate(S.merge_profiles(S.profile_state(df))).collect()}
    assert est == {"x": (1, 1, 0), "y": (1, 0, 1)}
    assert S.merge_profiles(S.profile_state(df.limit(0))).collect() == []
