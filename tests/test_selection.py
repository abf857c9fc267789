"""Radix selection against sorted values."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tendermatch.operators import selection as S
from tendermatch.operators.numeric import numeric_fit


def bits(x):
    n = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
    return -n if x < 0 else n


def test_keys_are_the_bits_of_the_values(spark):
    rng = random.Random(0)
    values = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308,
              float("inf"), float("-inf"), 0.1, 1 / 3]
    values += [2.0 ** k * s for k in range(-1074, 1024, 7) for s in (1, -1)]
    values += [np.nextafter(2.0 ** k, side) for k in range(-1020, 1024, 13) for side in (0.0, float("inf"))]
    while len(values) < 4000:
        x = struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0]
        if x == x:
            values.append(x)
    values = [float(v) for v in values]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for r in df.select("x", S.order_key(F.col("x")).alias("k")).collect():
        assert r.k == bits(r.x), r.x
        assert S.key_value(r.k) == r.x


@pytest.mark.parametrize("few", [1, 50, 1 << 12])
def test_ranks_of_sorted_values(spark, monkeypatch, few):
    monkeypatch.setattr(S, "FEW", few)
    rng = np.random.default_rng(1)
    cols = {"normal": rng.normal(size=3000), "tiny": 1 + rng.random(3000) * 1e-12, "hot": np.where(rng.random(3000) < 0.4, 7.0, rng.random(3000)),
            "whole": rng.integers(-50, 50, 3000).astype(float), "same": np.full(3000, -0.25)}
    df = spark.createDataFrame([tuple(None if k % 11 == 3 else float(v[k]) for v in cols.values()) for k in range(3000)],
                               ", ".join(f"{c} double" for c in cols)).repartition(5)
    keep = np.arange(3000) % 11 != 3
    sorted_ = {c: np.sort(v[keep]) for c, v in cols.items()}
    n = int(keep.sum())
    ranks = [0, 1, 17, n // 2, n // 2 + 1, n - 1]
    found = S.select_ranks(df, {c: [*ranks, n + 5] for c in cols})
    assert found == {(c, r): sorted_[c][r] for c in cols for r in ranks}
    got = S.quantiles(df, [(c, p) for c in cols for p in (0.0, 0.013, 0.5, 0.99, 1.0)])
    for (c, p), v in got.items():
        assert v == pytest.approx(np.percentile(sorted_[c], p * 100), rel=1e-12)


def test_no_values(spark):
    df = spark.createDataFrame([(None, 1.0)], "a double, b double")
    assert S.quantiles(df, [("a", 0.5), ("b", 0.5)]) == {("a", 0.5): None, ("b", 0.5): 1.0}
    assert S.select_ranks(df.limit(0), {"a": [0], "b": []}) == {}


@pytest.mark.parametrize("fill", ["median", "mode", 3, -100, 1000])
def test_bounds_of_the_filled_column(spark, fill):
    """Nulls move onto the fill value: below, inside, above or beyond the values."""
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=400) * 10, 1)
    holes = rng.random(400) < 0.3
    df = spark.createDataFrame([(k, None if h else float(v)) for k, (v, h) in enumerate(zip(x, holes))], "id long, x double").repartition(4)
    own = x[~holes]
    values, counts = np.unique(own, return_counts=True)
    f = {"median": np.median(own), "mode": values[counts.argmax()]}.get(fill, fill)
    filled = np.where(holes, f, x)
    model = numeric_fit(df, {"x": {"fill": fill, "clip": [2.5, 97]}}, ["id"])
    s = model.stats["x"]
    assert s["fill_value"] == pytest.approx(f)
    assert (s["clip_low"], s["clip_high"]) == pytest.approx(tuple(np.percentile(filled, [2.5, 97])))


def test_no_values_are_shuffled(spark):
    """No range partitioning and no sort in the passes."""
    df = spark.range(5000).select((F.col("id") * 1.37 % 11).alias("x"))
    level = df.unpivot([], ["x"], "column", "value").select("column", S.order_key(F.col("value")).alias("key"))
    plan = level.groupBy("column", F.shiftright("key", 52)).count()._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Sort" not in plan


def test_a_pass_takes_one_logarithm_a_value(spark):
    """A key is made in steps: as one expression it took the logarithm for each place where it is used."""
    values = [0.0, -0.0, 1.0, -1.0, 5e-324, 2.2250738585072014e-308, float("inf"), float("-inf"), 0.1, -1 / 3, 1e300, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    keyed = S.with_order_key(df, "x", "k")
    assert keyed.columns == ["x", "k"]
    assert [r.k for r in keyed.collect()] == [r.k for r in df.select(S.order_key(F.col("x")).alias("k")).collect()]
    grouped = keyed.groupBy(F.shiftright("k", 52), F.shiftright("k", 40)).count()
    assert grouped._jdf.queryExecution().optimizedPlan().toString().upper().count("LOG2(") == 1


def test_passes_keep_other_prefixes_apart(spark, monkeypatch):
    """Values under prefixes of no wanted rank, of either sign, count nowhere."""
    monkeypatch.setattr(S, "FEW", 1)
    values = [-5.5, -5.25, -1e9, 0.0, None, 3.0, 3.0, 3.0000001, 1e-9, 7.5e8]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    known = sorted(v for v in values if v is not None)
    for ranks in ([0, 8], [3], range(9)):
        assert S.select_ranks(df, {"x": ranks}) == {("x", r): known[r] for r in ranks}
