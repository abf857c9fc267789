"""Keyed tables that are updated in place.

A keyed table is a folder of Parquet files, cut into buckets by a hash of the
key, with a manifest for each version::

    base/data/v=<number>/tm_bucket=<b>/part-*   files that version <number> wrote
    base/manifest/v=<number>/                   bucket, source: whose files hold each bucket
    base/deltas/v=<number>/                     changed rows only, not yet in any bucket

Two ways to change a column by key:

* :func:`update` rewrites the buckets that hold a changed key and writes a
  manifest that names the old files for all others (copy on write);
* :func:`append_delta` stores the changes alone; :func:`read_merged` lays the
  newest change of each key over the table, and :func:`compact` moves changes
  into the buckets that they touch.

Files of a version are never overwritten by another one, so readers of an older
version are not disturbed. A version without its success mark does not count,
and a write under a number that exists already replaces that write alone:
repeated after a failure, it starts from the version below and gives what one
clean run gives.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tendermatch.operators.text import update_by_key
from tendermatch.sources.readers import _exists, _path

BUCKETS = 64
BUCKET = "tm_bucket"
MANIFEST = "bucket int, source long, buckets int, merged long"


def bucket_of(pk: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in pk]), F.lit(buckets)).cast("int")


def _folder(base: str, kind: str, number: int) -> str:
    return os.path.join(base, kind, f"v={number:012d}")


def versions(spark: SparkSession, base: str, kind: str = "manifest") -> list[int]:
    """Numbers of the complete versions (or ``deltas``), rising."""
    top = os.path.join(base, kind)
    if not _exists(spark, top):
        return []
    folder = _path(spark, top)
    names = [s.getPath().getName() for s in folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)]
    numbers = sorted(int(n[2:]) for n in names if n.startswith("v="))
    return [n for n in numbers if _exists(spark, os.path.join(_folder(base, kind, n), "_SUCCESS"))]


def _newest(spark: SparkSession, base: str, below: int | None = None) -> int:
    done = [n for n in versions(spark, base) if below is None or n < below]
    if not done:
        raise FileNotFoundError(f"no complete version under {base}")
    return done[-1]


def _manifest(spark: SparkSession, base: str, number: int) -> list:
    """A row for each bucket, at most."""
    return spark.read.schema(MANIFEST).json(_folder(base, "manifest", number)).orderBy("bucket").collect()


def _write(df: DataFrame, base: str, pk: Sequence[str], number: int, buckets: int, before: list, merged: int) -> list[int]:
    """Write the rows of whole buckets as version ``number``; buckets that it does not hold stay as ``before`` has them."""
    spark, out = df.sparkSession, _folder(base, "data", number)
    (df.withColumn(BUCKET, bucket_of(pk, buckets)).repartition(F.col(BUCKET)).write.mode("overwrite").partitionBy(BUCKET).parquet(out))
    folder = _path(spark, out)
    names = [s.getPath().getName() for s in folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)]
    written = sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{BUCKET}="))
    rows = {r.bucket: r.source for r in before} | dict.fromkeys(written, number)
    if rows:
        table = spark.createDataFrame([(b, s, buckets, merged) for b, s in sorted(rows.items())], MANIFEST)
    else:
        table = spark.createDataFrame([(None, None, buckets, merged)], MANIFEST)        # an empty table has a manifest as well
    table.coalesce(1).write.mode("overwrite").json(_folder(base, "manifest", number))
    return written


def create(df: DataFrame, base: str, pk: Sequence[str], buckets: int = BUCKETS) -> None:
    """Version 0 of a table. Keys must be unique; the schema is stored beside it."""
    spark = df.sparkSession
    if versions(spark, base):
        raise FileExistsError(f"{base} holds a table already")
    repeated = df.groupBy(*pk).count().where("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"repeated key: {repeated[0].asDict()}")
    spark.createDataFrame([(df.schema.json(),)], "schema string").coalesce(1).write.mode("overwrite").json(os.path.join(base, "schema"))
    _write(df, base, pk, 0, buckets, [], 0)


def _schema(spark: SparkSession, base: str):
    import json

    from pyspark.sql.types import StructType
    return StructType.fromJson(json.loads(spark.read.json(os.path.join(base, "schema")).first()[0]))


def _typed(spark: SparkSession, base: str, updates: DataFrame, pk: Sequence[str], col: str) -> DataFrame:
    """Keys and changed column in the types of the table."""
    schema = _schema(spark, base)
    return updates.select(*[F.col(c).cast(schema[c].dataType).alias(c) for c in [*pk, col]])


def _files(spark: SparkSession, base: str, rows: list) -> DataFrame:
    paths = [os.path.join(_folder(base, "data", r.source), f"{BUCKET}={r.bucket}") for r in rows if r.bucket is not None]
    schema = _schema(spark, base)
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read(spark: SparkSession, base: str, number: int | None = None) -> DataFrame:
    """The table as of version ``number`` (default: the newest), without changes that are deltas only."""
    return _files(spark, base, _manifest(spark, base, _newest(spark, base) if number is None else number))


def update(spark: SparkSession, base: str, updates: DataFrame, pk: Sequence[str], col: str, number: int | None = None,
           merged: int | None = None) -> list[int]:
    """Copy on write: ``col`` of the rows whose key ``updates`` has (see :func:`operators.text.update_by_key`).

    Only the buckets that the keys fall into are read and written; returns their numbers. ``number`` names the version,
    by default the next one.
    """
    updates = _typed(spark, base, updates, pk, col)
    before = _newest(spark, base, number)
    number = before + 1 if number is None else number
    rows = _manifest(spark, base, before)
    buckets = rows[0].buckets
    touched = {r[0] for r in updates.select(bucket_of(pk, buckets).alias("b")).distinct().collect()}        # at most ``buckets``
    own = _files(spark, base, [r for r in rows if r.bucket in touched])
    done = _write(update_by_key(own, updates, pk, col), base, pk, number, buckets, [r for r in rows if r.bucket is not None],
                  rows[0].merged if merged is None else merged)
    return done


def append_delta(updates: DataFrame, base: str, pk: Sequence[str], col: str, number: int) -> None:
    """Store the changes ``pk, col`` under a number (of a batch, say); no row of the table is read or written."""
    spark = updates.sparkSession
    updates = _typed(spark, base, updates, pk, col)
    repeated = updates.groupBy(*pk).count().where("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"more than one update for a key: {repeated[0].asDict()}")
    if number <= _manifest(spark, base, _newest(spark, base))[0].merged and number not in versions(spark, base, "deltas"):
        raise ValueError(f"change {number} comes after later ones were merged")
    updates.write.mode("overwrite").parquet(_folder(base, "deltas", number))


def _changes(spark: SparkSession, base: str, pk: Sequence[str], col: str, after: int, upto: int | None) -> tuple[DataFrame | None, int]:
    """The newest change of every key among the deltas ``after`` that are not in the buckets, and the last delta's number."""
    numbers = [n for n in versions(spark, base, "deltas") if n > after and (upto is None or n <= upto)]
    if not numbers:
        return None, after
    schema = _schema(spark, base)
    fields = ", ".join(f"`{c}` {schema[c].dataType.simpleString()}" for c in [*pk, col])
    rows = spark.read.schema(fields).parquet(*[_folder(base, "deltas", n) for n in numbers])
    number = F.regexp_extract(F.col("_metadata.file_path"), r"deltas/v=(\d+)/[^/]*$", 1).cast("long")
    newest = (rows.select(*pk, F.struct(F.col(col).alias("value")).alias("_tm_new"), number.alias("_tm_number"))
              .groupBy(*pk).agg(F.max_by("_tm_new", "_tm_number").alias("_tm_new")))
    return newest.select(*pk, F.col("_tm_new.value").alias(col)), numbers[-1]


def read_merged(spark: SparkSession, base: str, pk: Sequence[str], col: str, upto: int | None = None) -> DataFrame:
    """The newest version with the deltas (up to a number) laid over it: the newest change of a key holds."""
    rows = _manifest(spark, base, _newest(spark, base))
    changes, _ = _changes(spark, base, pk, col, rows[0].merged, upto)
    table = _files(spark, base, rows)
    return table if changes is None else update_by_key(table, changes, pk, col)


def compact(spark: SparkSession, base: str, pk: Sequence[str], col: str) -> list[int]:
    """Move the deltas into the buckets that they touch, as a new version; returns the buckets."""
    rows = _manifest(spark, base, _newest(spark, base))
    changes, last = _changes(spark, base, pk, col, rows[0].merged, None)
    return [] if changes is None else update(spark, base, changes, pk, col, merged=last)
