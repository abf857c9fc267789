"""Column profiles that add up (M1 for tables that grow).

A profile state has, for each column, the rows, the nulls, a HyperLogLog sketch
of the different values and the values that are frequent, with their counts.
States of partitions or chunks are stored and merged, so that a new chunk joins
the profile of a table without a look at the old rows.

Errors: the sketch has 2**LOG_REGISTERS registers, a relative standard error of
about 1.04 / sqrt(2**LOG_REGISTERS) (1.6 % for 12). The frequent values are kept
by the rule of Misra and Gries: of the values a state has counted, at most
``HEAVY`` stay, and the largest count of those that go is taken off all others.
A count is too low by at most ``lost``, which is at most rows / (HEAVY + 1); so
every value of a larger share is among them. :func:`operators.profile.column_profile`
is the exact way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LOG_REGISTERS = 12
HEAVY = 255


def _heaviest(counts: DataFrame, keys: Sequence[str], heavy: int) -> DataFrame:
    """``keys, top array<struct<value, n>>, lost`` of counts ``keys, value, n``: the counts above that of the value in
    place ``heavy + 1``, less that count."""
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), "value")
    first = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= heavy + 1)
    cut = F.coalesce(F.max(F.when(F.col("place") == heavy + 1, F.col("n"))).over(Window.partitionBy(*keys)), F.lit(0).cast("long"))
    kept = first.withColumn("lost", cut).withColumn("over", F.col("n") - F.col("lost"))
    item = F.when((F.col("place") <= heavy) & (F.col("over") > 0), F.struct("value", F.col("over").alias("n")))
    return kept.groupBy(*keys).agg(F.collect_list(item).alias("top"), F.max("lost").alias("lost"))


def profile_state(df: DataFrame, columns: Sequence[str] | None = None, heavy: int = HEAVY) -> DataFrame:
    """``column, n_rows, n_null, distinct binary, top, lost`` of the columns (values as text)."""
    names = list(columns or df.columns)
    long = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in names]).unpivot([], names, "column", "value")
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    base = counts.groupBy("column").agg(
        F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0).cast("long")).alias("n_null"),
        F.hll_sketch_agg("value", LOG_REGISTERS).alias("distinct"))
    return base.join(_heaviest(counts.where("value is not null"), ["column"], heavy), "column", "left").select(
        "column", "n_rows", "n_null", "distinct", F.coalesce("top", F.array().cast("array<struct<value:string,n:bigint>>")).alias("top"),
        F.coalesce("lost", F.lit(0).cast("long")).alias("lost"))


def merge_profiles(states: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """One state of the rows of several (``unionByName`` of stored ones)."""
    base = states.groupBy("column").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_null").alias("n_null"),
                                        F.hll_union_agg("distinct", F.lit(False)).alias("distinct"), F.sum("lost").alias("before"))
    counts = (states.select("column", F.explode("top").alias("own")).groupBy("column", F.col("own.value").alias("value"))
              .agg(F.sum("own.n").alias("n")))
    return base.join(_heaviest(counts, ["column"], heavy), "column", "left").select(
        "column", "n_rows", "n_null", "distinct", F.coalesce("top", F.array().cast("array<struct<value:string,n:bigint>>")).alias("top"),
        (F.col("before") + F.coalesce("lost", F.lit(0))).alias("lost"))


def profile_estimate(state: DataFrame) -> DataFrame:
    """``column, n_rows, n_null, n_distinct`` (estimated)."""
    return state.select("column", "n_rows", "n_null", F.hll_sketch_estimate("distinct").alias("n_distinct"))


def frequent_values(state: DataFrame, share: float) -> DataFrame:
    """``column, value, at_least, at_most`` of the values that may have the share of a column's rows; none that has it is
    missing as long as ``share > lost / n_rows``."""
    rows = state.select("column", "n_rows", "lost", F.explode("top").alias("own"))
    return (rows.select("column", F.col("own.value").alias("value"), F.col("own.n").alias("at_least"),
                        (F.col("own.n") + F.col("lost")).alias("at_most"), "n_rows")
            .where(F.col("at_most") >= F.lit(float(share)) * F.col("n_rows")).drop("n_rows"))
