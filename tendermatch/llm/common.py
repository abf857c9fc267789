"""Helpers shared by the operators: pinned tables and byte-wise text rules."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tendermatch.session import checkpoint_dir

#: The white space of every text rule here, as characters and as a class.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pin(df: DataFrame, label: str, *by: str) -> DataFrame:
    """Write an intermediate table to the shared checkpoint folder (a folder for
    each value of ``by``) and read it back: the lineage ends there, lost
    executors cost no recomputation and the work before it runs once."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tendermatch/{label}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession, *objects) -> Broadcast:
    """Objects for the workers of a job, as a broadcast variable (of a size that does not grow with the data).

    Code goes to workers by value, so a task's module globals are its own; a
    broadcast value is read once by a worker process and stays there for the
    tasks that follow. :func:`held` puts what is made from it in its place.
    """
    return spark.sparkContext.broadcast({"objects": cloudpickle.dumps(objects)})


def held(store: Broadcast, make: Callable):
    """What ``make(*objects)`` gave the first time in this worker process; a store serves one maker."""
    kept = store.value
    if "made" not in kept:
        kept["made"] = make(*pickle.loads(kept.pop("objects")))
    return kept["made"]


def remainder(id_col: str | Column, divisor: int) -> Column:
    """crc32 of an id's decimal text, modulo ``divisor``; null ids count as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col) if isinstance(id_col, str) else id_col, F.lit("")).cast("string")
                          .cast("binary")), F.lit(divisor))
