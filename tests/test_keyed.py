"""Keyed tables: copy on write, deltas, replays."""

import glob
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from tendermatch.sources import keyed as K
from tendermatch.sources.sinks import scratch_path


def table(spark, n=200):
    return spark.range(n).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"), F.lit("x").alias("other"))


def content(df):
    return {r.k: r.v for r in df.collect()}


def digests(base):
    return {p: hashlib.sha256(open(p, "rb").read()).hexdigest() for p in glob.glob(f"{base}/data/*/*/part-*")}


def changes(spark, rows):
    return spark.createDataFrame(rows, "k long, v long")


def test_an_update_rewrites_the_touched_buckets_alone(spark):
    base = scratch_path(spark, "keyed")
    K.create(table(spark), base, ["k"], buckets=16)
    before = digests(base)
    assert len(before) == 16
    done = K.update(spark, base, changes(spark, [(3, -3), (77, None), (9999, 1)]), ["k"], "v")
    want = {k: k * 10 for k in range(200)} | {3: -3, 77: None}
    assert content(K.read(spark, base)) == want
    assert content(K.read(spark, base, 0)) == {k: k * 10 for k in range(200)}
    after = digests(base)
    assert {p: after[p] for p in before} == before                                # nothing that was there changed
    assert len(after) - len(before) == len(done) <= 3
    assert K.versions(spark, base) == [0, 1]


def test_a_replayed_update_gives_one_result(spark):
    base = scratch_path(spark, "keyed")
    K.create(table(spark, 50), base, ["k"], buckets=4)
    first = changes(spark, [(1, 5), (2, 6)])
    K.update(spark, base, first, ["k"], "v", number=1)
    once = content(K.read(spark, base))
    K.update(spark, base, first.withColumn("v", F.col("v") + 0), ["k"], "v", number=1)
    assert content(K.read(spark, base)) == once and K.versions(spark, base) == [0, 1]
    os.makedirs(f"{base}/manifest/v=000000000009")                                # not complete: does not count
    assert content(K.read(spark, base)) == once
    with pytest.raises(ValueError):
        K.update(spark, base, first.union(first), ["k"], "v")
    with pytest.raises(FileExistsError):
        K.create(table(spark), base, ["k"])
    with pytest.raises(FileNotFoundError):
        K.read(spark, scratch_path(spark, "none"))
    with pytest.raises(ValueError):
        K.create(table(spark).union(table(spark)), scratch_path(spark, "twice"), ["k"])


def test_deltas_are_as_large_as_their_batch_and_the_newest_holds(spark):
    base = scratch_path(spark, "keyed")
    K.create(table(spark, 100), base, ["k"], buckets=8)
    before = digests(base)
    K.append_delta(spark.createDataFrame([(1, 100), (2, 200)], "k int, v short"), base, ["k"], "v", 1)
    K.append_delta(changes(spark, [(2, None), (500, 1)]), base, ["k"], "v", 2)
    K.append_delta(changes(spark, [(2, None), (500, 1)]), base, ["k"], "v", 2)    # a replay
    assert digests(base) == before
    assert sum(spark.read.parquet(p).count() for p in glob.glob(f"{base}/deltas/*")) == 4
    want = {k: k * 10 for k in range(100)} | {1: 100, 2: None}
    assert content(K.read_merged(spark, base, ["k"], "v")) == want
    assert content(K.read_merged(spark, base, ["k"], "v", upto=1))[2] == 200
    assert content(K.read(spark, base))[1] == 10
    assert 1 <= len(K.compact(spark, base, ["k"], "v")) <= 3
    assert content(K.read(spark, base)) == want == content(K.read_merged(spark, base, ["k"], "v"))
    assert K.compact(spark, base, ["k"], "v") == []
    with pytest.raises(ValueError, match="later"):
        K.append_delta(changes(spark, [(1, 1)]), base, ["k"], "v", 0)
    K.append_delta(changes(spark, [(1, 7)]), base, ["k"], "v", 3)
    assert content(K.read_merged(spark, base, ["k"], "v"))[1] == 7


def test_empty_tables_and_null_keys(spark):
    base = scratch_path(spark, "keyed")
    K.create(table(spark, 0), base, ["k"])
    assert K.read(spark, base).collect() == [] and K.update(spark, base, changes(spark, [(1, 1)]), ["k"], "v") == []
    assert K.read_merged(spark, base, ["k"], "v").columns == ["k", "v", "other"]
    base = scratch_path(spark, "keyed")
    K.create(changes(spark, [(None, 1), (2, 2)]), base, ["k"])
    K.update(spark, base, changes(spark, [(2, 3)]), ["k"], "v")
    assert content(K.read(spark, base)) == {None: 1, 2: 3}


def test_a_replayed_stream_of_texts(spark):
    from tendermatch.streaming.incremental import refresh_vectors_log
    from tests.test_sources import _uncommit
    src, base = scratch_path(spark, "texts"), scratch_path(spark, "vectors")
    spark.createDataFrame([(1, "one"), (2, "two")], "k long, t string").coalesce(1).write.parquet(f"{src}/a")
    K.create(spark.createDataFrame([(k, None) for k in (1, 2, 3)], "k long, v array<float>"), f"{base}/target", ["k"], buckets=2)
    run = lambda: content(refresh_vectors_log(spark, f"{src}/*", "k long, t string", f"{base}/target", ["k"], "t", "v", f"{base}/ck"))
    first = run()
    _uncommit(base)
    assert run() == first and [first[k] is None for k in (1, 2, 3)] == [False, False, True]
