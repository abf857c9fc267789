"""Scans (S1, S2, S4, S5, S10, S19).

Chunked and paged scans of the reference become partitioned scans: a JDBC
read is split on a numeric column into ``num_partitions`` ranges; files are
split by ``spark.sql.files.maxPartitionBytes``. No user loop over chunks.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Table scan (filters and projections are pushed into the scan by Catalyst)."""
    return spark.read.format(fmt).options(**options).load(path)


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict, partition_column: str | None = None,
              lower_bound: int | None = None, upper_bound: int | None = None, num_partitions: int | None = None,
              fetchsize: int = 50_000) -> DataFrame:
    """Database table or subquery ``(SELECT ...) t``; partitioned when a column is given."""
    opts = {**properties, "fetchsize": str(fetchsize)}
    if partition_column:
        return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower_bound, upperBound=upper_bound,
                               numPartitions=num_partitions, properties=opts)
    return spark.read.jdbc(url, table, properties=opts)


def read_csv(spark: SparkSession, path: str, schema: str | None = None, header: bool = True) -> DataFrame:
    """CSV with header; a UTF-8 byte order mark before the header is dropped by the reader."""
    r = spark.read.option("header", header).option("encoding", "UTF-8")
    if schema:
        r = r.schema(schema)
    df = r.csv(path)
    first = df.columns[0] if df.columns else None
    if first and first.startswith("﻿"):
        df = df.withColumnRenamed(first, first.lstrip("﻿"))
    return df


def load_snapshot(spark: SparkSession, base: str, name: str) -> DataFrame:
    """Single-file snapshot wins over a chunk directory; missing -> FileNotFoundError."""
    single = os.path.join(base, f"{name}.parquet")
    chunked = os.path.join(base, name)
    for p in (single, chunked):
        if _exists(spark, p):
            return spark.read.parquet(p)
    raise FileNotFoundError(f"no snapshot for {name} under {base}")


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _exists(spark: SparkSession, path: str) -> bool:
    hpath = _path(spark, path)
    return bool(hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hpath))


def count_records(spark: SparkSession, pattern: str, fmt: str = "parquet") -> int:
    """Count records over a glob of files."""
    return spark.read.format(fmt).load(pattern).count()
