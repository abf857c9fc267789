"""Column profile and classification (M1, M8).

The reference keeps a hand-written profile (type, null count, category count,
flags) per column and classifies columns from it. Here the profile is computed
from the table (exact value counts, or approximate ones on request) and
the classification rules are applied to it:

* PK columns -> ``pk``; numeric types -> ``numeric``;
* strings -> ``categorical`` when declared so (or, without a declaration, when
  the distinct count is at most ``max_categories``), else ``text``;
* everything else (timestamps, dates, ...) -> ``dropped``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def column_profile(df: DataFrame, pk: Sequence[str] = (), categorical: Sequence[str] | None = None,
                   max_categories: int = 1000, exact: bool = True, use: Sequence[str] | None = None) -> DataFrame:
    cols = [f for f in df.schema.fields if use is None or f.name in use]
    names = [f.name for f in cols]
    if exact:
        # values are counted map-side per column, so that a row is not multiplied for a distinct aggregate each
        long = df.select(*[F.col(c).cast("string").alias(c) for c in names]).unpivot([], names, "column", "value")
        counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        stacked = counts.groupBy("column").agg(
            F.sum("n").alias("__rows"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("n_null"),
            F.count("value").alias("n_distinct"))
    else:
        row = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(c).alias(f"{c}__n") for c in names],
                     *[F.approx_count_distinct(c).alias(f"{c}__d") for c in names])
        stacked = row.select("__rows", F.inline(F.array(*[
            F.struct(F.lit(c).alias("column"), (F.col("__rows") - F.col(f"{c}__n")).alias("n_null"),
                     F.col(f"{c}__d").alias("n_distinct")) for c in names])))
    spark = df.sparkSession
    meta = []
    for i, f in enumerate(cols):
        if f.name in pk:
            role = "pk"
        elif isinstance(f.dataType, _NUMERIC):
            role = "numeric"
        elif isinstance(f.dataType, T.StringType):
            role = "categorical" if (categorical is not None and f.name in categorical) else (
                "text" if categorical is not None else None)
        else:
            role = "dropped"
        meta.append((i, f.name, f.dataType.simpleString(), role))
    m = spark.createDataFrame(meta, "ord int, column string, dtype string, role string")
    # an empty table has no counted value: its columns are added with zeros
    stacked = m.select("column").join(stacked, "column", "left").na.fill(0)
    out = stacked.join(F.broadcast(m), "column")
    out = out.withColumn("role", F.coalesce(F.col("role"), F.when(F.col("n_distinct") <= max_categories,
                                                                 "categorical").otherwise("text")))
    return out.select("column", "dtype", F.col("__rows").alias("n_rows"), "n_null", "n_distinct", "role", "ord")


def vocab_sizes(profile: DataFrame, columns: Sequence[str], margin: int = 10, default: int = 1000) -> DataFrame:
    """M8: category count + margin per requested column; ``default`` when the profile lacks it."""
    spark = profile.sparkSession
    req = spark.createDataFrame([(c,) for c in columns], "column string")
    cat = profile.where(F.col("role") == "categorical").select("column", "n_distinct")
    return req.join(F.broadcast(cat), "column", "left").select(
        "column", F.coalesce(F.col("n_distinct") + margin, F.lit(default)).cast("long").alias("vocab_size"))
