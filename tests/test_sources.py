"""Sinks, snapshots, the pluggable encoder and the pipeline run on literal fixtures."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tendermatch.operators.text import text_transform, update_by_key
from tendermatch.sources import readers as R
from tendermatch.sources import sinks as S


def test_table_sink_modes_and_key_check(spark):
    df = spark.createDataFrame([(1, "a", [1.0, 2.0], 3), (2, "b", None, 4)], "k long, s string, v array<double>, i int")
    path = S.scratch_path(spark, "sink-test")
    S.write_table(df, path, ["k"], if_exists="fail")
    back = spark.read.parquet(path)
    assert back.columns == ["k", "s", "i", "v"]                       # key first, vectors last
    assert dict(back.dtypes) == {"k": "string", "s": "string", "i": "bigint", "v": "array<float>"}
    with pytest.raises(Exception):
        S.write_table(df, path, ["k"], if_exists="fail")              # exists -> error
    S.write_table(df.withColumn("k", F.col("k") + 10), path, ["k"], if_exists="append")
    assert spark.read.parquet(path).count() == 4
    with pytest.raises(ValueError, match="stored already"):
        S.write_table(df.where("k = 1"), path, ["k"], if_exists="append")
    assert spark.read.parquet(path).count() == 4
    dup = spark.createDataFrame([(1, "a"), (1, "b")], "k long, s string")
    with pytest.raises(ValueError, match="primary key"):
        S.write_table(dup, S.scratch_path(spark, "dup"), ["k"], if_exists="replace")
    nul = spark.createDataFrame([(None, "a")], "k long, s string")
    with pytest.raises(ValueError, match="primary key"):
        S.write_table(nul, S.scratch_path(spark, "nul"), ["k"], if_exists="replace")


def test_snapshot_manifest_empty_and_isolation(spark):
    df = spark.range(25).withColumn("x", F.col("id") * 2)
    path = S.scratch_path(spark, "snap")
    man = S.snapshot(df.repartition(1), path, chunk_size=10, compression="gzip")
    assert man["total_rows"] == 25 and man["chunk_count"] == 3 and man["largest"] == 10      # at most 10 rows per file
    files = S.read_manifest(spark, path).collect()
    assert sorted(r.rows for r in files) == [5, 10, 10] and all(r.file.endswith(".gz.parquet") for r in files)
    one = S.scratch_path(spark, "one")
    assert S.snapshot(df.repartition(4), one, chunk_size=10, single_file=True)["chunk_count"] == 1
    assert S.snapshot(df.where("id < 0"), S.scratch_path(spark, "empty")) is None
    bad = df.select(F.raise_error(F.lit("boom")).alias("x"))
    done = {r.table: r for r in S.snapshot_many(spark, {"good": (df, S.scratch_path(spark, "g")), "bad": (bad, S.scratch_path(spark, "b")),
                                                        "none": (df.limit(0), S.scratch_path(spark, "n"))}).collect()}
    assert done["good"].rows == 25 and done["good"].error is None
    assert done["bad"].path is None and "boom" in done["bad"].error
    assert done["none"].rows == 0 and done["none"].path is None and done["none"].error is None
    assert R.load_snapshot(spark, os.path.dirname(path), os.path.basename(path)).count() == 25
    with pytest.raises(FileNotFoundError):
        R.load_snapshot(spark, os.path.dirname(path), "missing-table")


def test_encoder_and_update_by_key(spark):
    def encoder(df, col):
        return df.withColumn(col, F.array(F.length(col).cast("double"), F.regexp_count(col, F.lit("a")).cast("double")))

    df = spark.createDataFrame([(1, "  Banana "), (1, "a"), (None, None)], "id long, t string")
    out = sorted(((r.id, r.t) for r in text_transform(df, ["id"], {"t": {"l2_normalize": False}}, encoder=encoder).collect()), key=repr)
    assert out == [(1, [1.0, 1.0]), (1, [6.0, 3.0]), (None, [0.0, 0.0])]      # cleaned text, NULL -> '', no row merges
    target = spark.createDataFrame([(1, [0.0]), (2, [5.0]), (3, [6.0])], "id long, v array<double>")
    upd = spark.createDataFrame([(2, [7.0]), (9, [1.0]), (3, None)], "id long, v array<double>")
    got = {r.id: r.v for r in update_by_key(target, upd, ["id"], "v").collect()}
    assert got == {1: [0.0], 2: [7.0], 3: None}                       # unmatched updates are ignored, NULL sets NULL
    with pytest.raises(ValueError, match="more than one update"):
        update_by_key(target, upd.union(upd), ["id"], "v")


@pytest.mark.parametrize("dim", [1, 8, 20, 40])
def test_hashed_vectors_of_any_width(spark, dim):
    import hashlib

    from tendermatch.functions.text import hashed_embedding
    df = spark.createDataFrame([("one two two",), ("",), (None,), (" x ",)], "t string")
    got = [r.t for r in hashed_embedding(df, "t", dim).collect()]

    def vector(word):
        text = "".join(hashlib.md5((word if k == 0 else f"{word}#{k}").encode()).hexdigest() for k in range(2))
        return np.array([(int(text[k], 16) - 7.5) / 7.5 for k in range(dim)])

    np.testing.assert_allclose(got[0], (vector("one") + 2 * vector("two")) / 3, atol=1e-12)
    np.testing.assert_allclose(got[3], vector("x"), atol=1e-12)
    assert got[1] == got[2] == [0.0] * dim


def test_run_log_row_fills_missing(spark):
    vals = spark.createDataFrame([(0.5, 3)], "val_loss double, test_batches long")
    row = S.run_log_row(spark, vals).collect()[0].asDict()
    assert row["val_loss"] == "0.5" and row["test_batches"] == "3" and row["mrr"] == "N/A"
    assert list(row) == S.RUN_LOG_COLUMNS


def _stream(spark, base, src):
    from tendermatch.streaming.incremental import transform_stream
    return transform_stream(spark, f"{src}/*", "k long, x double", prepare=lambda s: s, transform=lambda d: d, pk=["k"],
                            sink=f"{base}/sink", checkpoint=f"{base}/ck")


def _uncommit(base):
    """Undo the commit of the last batch, as if the driver had died after its write."""
    folder = f"{base}/ck/commits"
    last = max((f for f in os.listdir(folder) if f.isdigit()), key=int)
    for f in (last, f".{last}.crc"):
        if os.path.exists(f"{folder}/{f}"):
            os.remove(f"{folder}/{f}")


def test_stream_rejects_keys_repeated_across_batches(spark):
    src = S.scratch_path(spark, "stream-src")
    spark.createDataFrame([(1, 1.0), (2, 2.0)], "k long, x double").coalesce(1).write.parquet(f"{src}/a")
    spark.createDataFrame([(3, 3.0), (1, 4.0)], "k long, x double").coalesce(1).write.parquet(f"{src}/b")
    with pytest.raises(Exception, match="repeat"):
        _stream(spark, S.scratch_path(spark, "stream-out"), src)


def test_replayed_batch_gives_one_clean_run(spark):
    src = S.scratch_path(spark, "stream-src")
    spark.createDataFrame([(1, 1.0), (2, 2.0)], "k long, x double").coalesce(1).write.parquet(f"{src}/a")
    spark.createDataFrame([(3, 3.0), (4, 4.0)], "k long, x double").coalesce(1).write.parquet(f"{src}/b")
    base = S.scratch_path(spark, "stream-out")
    read = lambda df: sorted((r.k, r.x) for r in df.collect())
    first = read(_stream(spark, base, src))
    _uncommit(base)
    assert read(_stream(spark, base, src)) == first == [(1, 1.0), (2, 2.0), (3, 3.0), (4, 4.0)]


def test_replayed_vector_refresh_starts_from_the_same_version(spark):
    from tendermatch.streaming.incremental import refresh_vectors_stream
    src, base = S.scratch_path(spark, "texts"), S.scratch_path(spark, "vectors")
    spark.createDataFrame([(1, "one"), (2, "two")], "k long, t string").coalesce(1).write.parquet(f"{src}/a")
    spark.createDataFrame([(k, None) for k in (1, 2, 3)], "k long, v array<float>").write.parquet(f"{base}/target/v=000000000")
    os.makedirs(f"{base}/target/v=000000007")                          # not complete: never read
    run = lambda: refresh_vectors_stream(spark, f"{src}/*", "k long, t string", f"{base}/target", ["k"], "t", "v", f"{base}/ck")
    read = lambda p: sorted((r.k, r.v) for r in spark.read.parquet(p).collect())
    first = read(run())
    _uncommit(base)
    assert read(run()) == first and [v is None for _, v in first] == [False, False, True]


def test_run_log_is_stored(spark):
    path = S.scratch_path(spark, "log")
    for k in range(3):
        row = spark.createDataFrame([(str(k), 0.5 * k)], "timestamp string, val_loss double")
        log = S.append_run_log(spark, path, S.run_log_row(spark, row)).collect()
    assert [(r.timestamp, r.val_loss, r.mrr) for r in log] == [("0", "0.0", "N/A"), ("1", "0.5", "N/A"), ("2", "1.0", "N/A")]


def test_bucketed_tables_join_without_shuffle(spark):
    import io
    from contextlib import redirect_stdout
    a = spark.range(200).select(F.col("id").cast("string").alias("k"), (F.col("id") * 2).alias("x"))
    b = spark.range(200).select(F.col("id").cast("string").alias("k"), (F.col("id") * 3).alias("y"))
    S.write_table(a, S.scratch_path(spark, "ta"), ["k"], if_exists="replace", table="tm_bucket_a", buckets=4)
    S.write_table(b, S.scratch_path(spark, "tb"), ["k"], if_exists="replace", table="tm_bucket_b", buckets=4)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = spark.table("tm_bucket_a").join(spark.table("tm_bucket_b"), "k")
        buf = io.StringIO()
        with redirect_stdout(buf):
            j.explain()
        assert "Exchange" not in buf.getvalue()
        assert j.count() == 200
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql("DROP TABLE IF EXISTS tm_bucket_a")
        spark.sql("DROP TABLE IF EXISTS tm_bucket_b")


def test_csv_with_byte_order_mark(spark):
    path = S.scratch_path(spark, "bom")
    os.makedirs(path)
    with open(f"{path}/a.csv", "wb") as f:
        f.write(b"\xef\xbb\xbfkey,name\n1,a\n2,b\n")
    assert sorted(tuple(r) for r in R.read_csv(spark, path).select("key", "name").collect()) == [("1", "a"), ("2", "b")]


def test_all_pairs_are_loaded(spark):
    import __spark_entry__ as E
    from tendermatch.plans import roles
    from tests.conftest import SMALL
    n = roles.pairs(spark, SMALL).count()
    assert n > 1000 and E.queries()["pairs_loaded_all"](spark, SMALL).count() == n


def test_growing_tables_are_not_written_by_one_task(spark, monkeypatch):
    import __spark_entry__ as E
    from tests.conftest import SMALL
    calls, snapshot = [], S.snapshot
    monkeypatch.setattr(S, "snapshot", lambda df, path, **kw: calls.append(kw) or snapshot(df, path, **kw))
    assert E.queries()["snapshot_reload"](spark, SMALL).count() == 3
    assert len(calls) == 2 and not any(kw.get("single_file") for kw in calls)
