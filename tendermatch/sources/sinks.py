"""Sinks (S6-S9, S11-S15, S20, S21).

* table sink with fail / replace / append modes, PK checked before the write;
* physical schema: PK first (string, NOT NULL), regular columns, vectors last;
* Parquet snapshots with codec and records per file, and a manifest beside the
  files, derived from what was written;
* versioned rewrite for update-by-key: a new directory per version, never an
  overwrite of the path being read.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tendermatch.operators.contracts import assert_pk
from tendermatch.session import checkpoint_dir
from tendermatch.sources.readers import _exists, _path

MODES = {"fail": "errorifexists", "replace": "overwrite", "append": "append"}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never a machine-local temp dir)."""
    return os.path.join(checkpoint_dir(spark), "tendermatch-out", f"{name}-{uuid.uuid4().hex[:12]}")


def physical_schema(df: DataFrame, pk: Sequence[str]) -> DataFrame:
    """PK first as string, then scalar columns (int->bigint, float->double), vectors last."""
    scal, vecs = [], []
    for f in df.schema.fields:
        if f.name in pk:
            continue
        if isinstance(f.dataType, T.ArrayType):
            vecs.append(F.col(f.name).cast("array<float>").alias(f.name))
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            scal.append(F.col(f.name).cast("long").alias(f.name))
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            scal.append(F.col(f.name).cast("double").alias(f.name))
        elif isinstance(f.dataType, T.BooleanType):
            scal.append(F.col(f.name))
        else:
            scal.append(F.col(f.name).cast("string").alias(f.name))
    return df.select(*[F.col(k).cast("string").alias(k) for k in pk], *scal, *vecs)


def ensure_vector_column(df: DataFrame, col: str, dims: int | None = None) -> DataFrame:
    """Add an empty vector column when it is missing."""
    if col in df.columns:
        return df
    return df.withColumn(col, F.lit(None).cast("array<float>"))


def append_conflicts(df: DataFrame, stored: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Keys of ``df`` that the stored table has already (as text, the way the table keeps them)."""
    keys = df.select(*[F.col(k).cast("string").alias(k) for k in pk])
    return keys.join(stored.select(*[F.col(k).cast("string").alias(k) for k in pk]), list(pk), "left_semi")


def write_table(df: DataFrame, path: str, pk: Sequence[str], if_exists: str = "fail", fmt: str = "parquet",
                table: str | None = None, buckets: int | None = None) -> None:
    """S11 + S12 + S13: checked keys, physical schema, mode fail / replace / append.

    An append is checked against the keys stored already, so the key holds for
    the table and not only for the call. With ``table`` and ``buckets`` the
    table is bucketed and sorted by its key, so later joins and aggregations on
    the key read it without a shuffle.
    """
    spark = df.sparkSession
    out = physical_schema(assert_pk(df, pk), pk)
    if if_exists == "append" and _exists(spark, path):
        clash = append_conflicts(out, spark.read.format(fmt).load(path), pk).limit(1).collect()
        if clash:
            raise ValueError(f"primary key {list(pk)} is stored already: {clash[0].asDict()}")
    w = out.write.mode(MODES[if_exists]).format(fmt)
    if table:
        if buckets:
            w = w.bucketBy(buckets, *pk).sortBy(*pk)
        w.option("path", path).saveAsTable(table)
    else:
        w.save(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header CSV, no index column (Spark writes no byte order mark)."""
    df.write.mode(mode).option("header", True).csv(path)


def snapshot(df: DataFrame, path: str, chunk_size: int = 100_000, compression: str = "snappy",
             single_file: bool = False) -> dict | None:
    """S7 + S8: Parquet snapshot with its manifest; an empty table gives no output (None).

    Files hold at most ``chunk_size`` rows. ``single_file`` writes one file
    instead (one task writes it all: for tables that the caller knows to be small).
    """
    if df.isEmpty():
        return None
    w = (df.coalesce(1) if single_file else df).write.mode("overwrite").option("compression", compression)
    if not single_file:
        w = w.option("maxRecordsPerFile", chunk_size)
    w.parquet(path)
    return write_manifest(df.sparkSession, path, compression, None if single_file else chunk_size)


def write_manifest(spark: SparkSession, path: str, compression: str, chunk_size: int | None) -> dict:
    """One JSON row per written file beside the files (``_manifest``, which readers of the snapshot skip) and a
    summary. Row counts come from the file footers (no column is read); the list of files stays distributed."""
    files = (spark.read.parquet(path).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("rows"))
             .withColumn("compression", F.lit(compression)).withColumn("chunk_size", F.lit(chunk_size).cast("long")))
    files.write.mode("overwrite").json(os.path.join(path, "_manifest"))
    r = read_manifest(spark, path).agg(F.sum("rows"), F.count(F.lit(1)), F.max("rows")).collect()[0]
    return {"path": path, "total_rows": r[0], "chunk_count": r[1], "largest": r[2], "chunk_size": chunk_size, "compression": compression}


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``file, rows, compression, chunk_size`` of a snapshot's files. The listing is explicit: readers hide names with ``_``."""
    folder = _path(spark, os.path.join(path, "_manifest"))
    names = [str(f.getPath()) for f in folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
             if f.getPath().getName().startswith("part-")]
    return spark.read.schema("file string, rows long, compression string, chunk_size long").json(names)


def snapshot_many(spark: SparkSession, jobs: dict[str, tuple[DataFrame, str]], max_workers: int = 4, **kw) -> DataFrame:
    """Several snapshots as concurrent Spark jobs: ``table, path, rows, error``, a row per table. One failure does
    not stop the others; its cause is in ``error``. An empty table has neither path nor error."""
    def one(item):
        name, (df, path) = item
        try:
            done = snapshot(df, path, **kw)
            return name, done and path, done["total_rows"] if done else 0, None
        except Exception as e:  # noqa: BLE001 - isolation per table is the contract
            return name, None, None, f"{type(e).__name__}: {e}"[:500]
    with ThreadPoolExecutor(max_workers=max_workers) as pool:
        return spark.createDataFrame(list(pool.map(one, jobs.items())), "table string, path string, rows long, error string")


def write_versioned(df: DataFrame, base: str) -> str:
    """S15 writer: each rewrite goes to a new version folder (readers of the old one are unaffected)."""
    path = os.path.join(base, f"v-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path)
    return path


# Fixed format: the columns of the experiment log, in order.
RUN_LOG_COLUMNS = ["timestamp", "batch_size", "model_params", "embedding_dim", "final_embedding_dim", "hidden_dims",
                   "learning_rate", "epochs", "train_loss", "train_acc", "val_loss", "val_acc", "recall_at_5",
                   "recall_at_10", "mrr", "similarity_gap", "train_batches", "test_batches", "gpu_optimization"]


def run_log_row(spark: SparkSession, values: DataFrame) -> DataFrame:
    """One experiment-log row: every log column as text, ``N/A`` where the input lacks it."""
    cols = []
    for c in RUN_LOG_COLUMNS:
        cols.append(F.coalesce(F.col(c).cast("string"), F.lit("N/A")).alias(c) if c in values.columns
                    else F.lit("N/A").alias(c))
    return values.select(*cols)


def append_run_log(spark: SparkSession, path: str, row: DataFrame) -> DataFrame:
    """Append a row to the stored log (created when missing) and read the log back in order of its timestamps.

    Rows of an older log that lack a column read ``N/A`` there."""
    row.write.mode("append").option("header", True).csv(path)
    log = spark.read.option("header", True).csv(path)
    for c in RUN_LOG_COLUMNS:
        if c not in log.columns:
            log = log.withColumn(c, F.lit(None).cast("string"))
    return log.select(*RUN_LOG_COLUMNS).fillna("N/A").orderBy("timestamp")


def save_state(spark: SparkSession, path: str, tables: dict[str, DataFrame], config: dict) -> None:
    """Fitted state as Parquet tables plus a JSON config beside them."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(os.path.join(path, name))
    spark.createDataFrame([(json.dumps(config),)], "config string").write.mode("overwrite").json(
        os.path.join(path, "config"))


def load_state(spark: SparkSession, path: str, names: Sequence[str]) -> tuple[dict[str, DataFrame], dict]:
    tables = {n: spark.read.parquet(os.path.join(path, n)) for n in names}
    cfg = json.loads(spark.read.json(os.path.join(path, "config")).collect()[0]["config"])
    return tables, cfg
