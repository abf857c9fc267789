"""Page index and key filters."""

import os

import pytest
from pyspark.sql import functions as F

from tendermatch.sources import keyfilter as B
from tendermatch.sources import paging as P
from tendermatch.sources.sinks import scratch_path


def test_pages_open_the_files_they_cover(spark):
    base = scratch_path(spark, "pages")
    df = spark.range(0, 3000, 3).select((F.col("id") * 7919 % 3001).alias("k"), F.col("id").alias("begin"), F.lit("x").alias("file")).repartition(5)
    want = sorted((r.k, r.begin) for r in df.collect())
    P.build_page_index(df, base, ["k"], rows_per_file=64)
    for offset, limit in ((0, 10), (40, 100), (64, 64), (995, 50), (0, 1000), (500, 1)):
        own = P.read_page(spark, base, offset, limit)
        assert own.columns == ["k", "begin", "file"]
        assert [(r.k, r.begin) for r in own.collect()] == want[offset:offset + limit]
        assert len(own.inputFiles()) <= limit // 20 + 3
    assert P.read_page(spark, base, 1000, 5).collect() == [] and P.read_page(spark, base, 3, 0).collect() == []
    with pytest.raises(ValueError):
        P.read_page(spark, base, -1, 5)


def test_pages_of_composite_keys_nulls_and_no_rows(spark):
    base = scratch_path(spark, "pages")
    rows = [(None, 2), (None, 1), ("a", None), ("a", 1), ("b", 0)]
    P.build_page_index(spark.createDataFrame(rows, "a string, b int").repartition(3), base, ["a", "b"], rows_per_file=2)
    assert [tuple(r) for r in P.read_page(spark, base, 0, 9).collect()] == [(None, 1), (None, 2), ("a", None), ("a", 1), ("b", 0)]
    base = scratch_path(spark, "pages")
    P.build_page_index(spark.createDataFrame([], "a string"), base, ["a"])
    assert P.read_page(spark, base, 0, 9).collect() == []


def test_filters_have_no_false_negatives_and_few_false_positives(spark):
    old = spark.range(4000).select(F.col("id").cast("string").alias("a"), (F.col("id") % 7).alias("b"))
    filt = B.key_filter(old, ["a", "b"], width=2048)
    assert B.maybe_stored(old, ["a", "b"], filt, 2048).count() == 4000
    new = old.withColumn("a", F.concat("a", F.lit("x")))
    assert B.maybe_stored(new, ["a", "b"], filt, 2048).count() < 400
    wide = B.key_filter(old, ["a", "b"], width=1 << 20)
    assert B.maybe_stored(new, ["a", "b"], wide, 1 << 20).count() < 8
    halves = [B.key_filter(old.where(F.col("b") < 3), ["a", "b"], 2048), B.key_filter(old.where(F.col("b") >= 3), ["a", "b"], 2048)]
    merged = B.merge_filters(halves[0].unionByName(halves[1]))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, filt.collect()))


def test_an_append_without_clashes_reads_no_stored_key(spark):
    log = B.KeyLog(spark, scratch_path(spark, "log"), ["k"], partitions=8)
    frame = lambda ids: spark.createDataFrame([(f"key-{i}" if i is not None else None,) for i in ids], "k string")     # noqa: E731
    assert log.clashes(frame([1])) is None
    log.add(frame(range(500)), 0)
    log.add(frame(range(500, 900)), 1)
    # the stored keys go away: whoever reads them would fail
    hidden = log.keys
    log.keys = os.path.join(log.keys, "elsewhere")
    assert log.clashes(frame(range(2000, 2300))) is None and log.read_parts == 0
    log.keys = hidden
    planted = frame([*range(3000, 3100), 17, 899])
    assert sorted(r.k for r in log.clashes(planted).collect()) == ["key-17", "key-899"] and 1 <= log.read_parts <= 8
    assert log.clashes(frame(range(500)), batch=0) is None or log.clashes(frame(range(500)), batch=0).isEmpty()
    log.add(frame([None]), 2)
    assert log.clashes(frame([None])).count() == 1
    log.add(frame(range(500)), 0)                                                 # a replay
    assert spark.read.parquet(log.keys).count() == 901
