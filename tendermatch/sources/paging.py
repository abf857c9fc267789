"""A stored page index (S4, L4): a table written in its order, and a small table of its files.

The index has one row for each file: its first key, its number of rows and the
place of its first row in the whole order. A page asks the index which files it
covers and opens those alone, at any depth; nothing is sorted or counted again.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendermatch.operators.ranking import with_running_total

ROWS_PER_FILE = 100_000


def build_page_index(df: DataFrame, base: str, order_by: Sequence[str], rows_per_file: int = ROWS_PER_FILE) -> None:
    """Write ``df`` under ``base/rows`` in the order of ``order_by`` (unique keys, nulls first), at most ``rows_per_file``
    rows a file, and its index under ``base/index``."""
    spark, rows = df.sparkSession, os.path.join(base, "rows")
    (df.repartitionByRange(*order_by).sortWithinPartitions(*order_by).write.mode("overwrite")
     .option("maxRecordsPerFile", rows_per_file).parquet(rows))
    files = (spark.read.schema(df.schema).parquet(rows).select(*order_by, F.col("_metadata.file_name").alias("_tm_file"))
             .groupBy("_tm_file").agg(F.count(F.lit(1)).alias("_tm_rows"), F.min(F.struct(*order_by)).alias("_tm_first")))
    placed = with_running_total(files, ["_tm_first"], "_tm_rows", name="_tm_end")
    (placed.select(F.col("_tm_file").alias("file"), F.col("_tm_first").alias("first"), F.col("_tm_rows").alias("rows"),
                   (F.col("_tm_end") - F.col("_tm_rows")).alias("begin"), F.col("_tm_end").alias("end"))
     .repartitionByRange("begin").sortWithinPartitions("begin").write.mode("overwrite").parquet(os.path.join(base, "index")))
    spark.createDataFrame([(df.schema.json(),)], "schema string").coalesce(1).write.mode("overwrite").json(os.path.join(base, "schema"))


def page_files(spark: SparkSession, base: str, offset: int, limit: int) -> list:
    """``file, begin`` of the files that a page covers: at most two more than its rows fill."""
    index = spark.read.parquet(os.path.join(base, "index"))
    return index.where((F.col("end") > offset) & (F.col("begin") < offset + limit)).select("file", "begin").orderBy("begin").collect()


def read_page(spark: SparkSession, base: str, offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit - 1`` in the order of the index; fewer at the end, none beyond it."""
    import json

    from pyspark.sql.types import StructType
    if offset < 0 or limit < 0:
        raise ValueError("offset and limit must not be negative")
    schema = StructType.fromJson(json.loads(spark.read.json(os.path.join(base, "schema")).first()[0]))
    files = page_files(spark, base, offset, limit) if limit else []
    if not files:
        return spark.createDataFrame([], schema)
    begin = F.create_map(*[x for f in files for x in (F.lit(f.file), F.lit(f.begin).cast("long"))])
    rows = spark.read.schema(schema).parquet(*[os.path.join(base, "rows", f.file) for f in files])
    place = (begin[F.col("_metadata.file_name")] + F.col("_metadata.row_index")).alias("_tm_place")
    return (rows.select("*", place).where(F.col("_tm_place").between(offset, offset + limit - 1)).orderBy("_tm_place").drop("_tm_place"))
