"""Persisted Bloom filters of stored keys.

The keys of a table, or of each batch, are remembered as a sparse array of
64-bit words: a key sets a few bits of one word. A new key can be among the
stored ones only if all its bits are set, so an append joins its keys with the
words, one row each, and reads the stored keys themselves only where that says
"maybe", in the partitions of those keys. Filters of the same width are merged
by OR of equal words; they are built and merged by Spark aggregates.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tendermatch.sources.readers import _exists

WIDTH = 1 << 24          # words of a filter: 64 M keys at 16 bits each; more keys cost more exact checks, not correctness
PROBES = 5


def _word(pk: Sequence[str], width: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(0), *[F.col(k).cast("string") for k in pk]), F.lit(width)).cast("long").alias("word")


def _bits(pk: Sequence[str]) -> Column:
    h = F.xxhash64(F.lit(1), *[F.col(k).cast("string") for k in pk])
    bits = F.lit(0).cast("long")
    for k in range(PROBES):
        place = F.shiftrightunsigned(h, 6 * k).bitwiseAND(63).cast("int")
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return bits.alias("bits")


def key_filter(df: DataFrame, pk: Sequence[str], width: int = WIDTH) -> DataFrame:
    """``word, bits``: the filter of the keys of ``df``."""
    return df.select(_word(pk, width), _bits(pk)).groupBy("word").agg(F.bit_or("bits").alias("bits"))


def merge_filters(filters: DataFrame) -> DataFrame:
    """One filter of the rows of several."""
    return filters.groupBy("word").agg(F.bit_or("bits").alias("bits"))


def maybe_stored(df: DataFrame, pk: Sequence[str], stored: DataFrame, width: int = WIDTH) -> DataFrame:
    """Rows of ``df`` whose key may be among those of the filter; all others are not. Null keys count as a value."""
    probe = df.withColumns({"_tm_word": _word(pk, width), "_tm_bits": _bits(pk)})
    words = stored.select(F.col("word").alias("_tm_word"), F.col("bits").alias("_tm_set"))
    return (probe.join(words, "_tm_word").where(F.col("_tm_bits").bitwiseAND(F.col("_tm_set")) == F.col("_tm_bits"))
            .drop("_tm_word", "_tm_bits", "_tm_set"))


class KeyLog:
    """Keys of the batches of a table: ``base/keys`` (by batch and hash partition) and ``base/filters`` (by batch)."""

    def __init__(self, spark: SparkSession, base: str, pk: Sequence[str], partitions: int = 64, width: int = WIDTH):
        self.spark, self.pk, self.partitions, self.width = spark, list(pk), partitions, width
        self.keys, self.filters = os.path.join(base, "keys"), os.path.join(base, "filters")
        self.read_parts = 0              # partitions of stored keys that the last check read

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.pk]), F.lit(self.partitions)).cast("int")

    def clashes(self, df: DataFrame, batch: int | None = None) -> DataFrame | None:
        """Keys of ``df`` that batches other than ``batch`` have stored; None when the filters rule out all of them, and
        then no stored key is read."""
        self.read_parts = 0
        if not _exists(self.spark, self.filters):
            return None
        own = df.select(*[F.col(k) for k in self.pk])
        known = self.spark.read.parquet(self.filters)
        if batch is not None:
            known = known.where(F.col("batch") != batch)
        maybe = maybe_stored(own, self.pk, merge_filters(known), self.width).withColumn("part", self._part())
        parts = [r.part for r in maybe.select("part").distinct().collect()]           # at most ``partitions`` numbers
        if not parts:
            return None
        stored = self.spark.read.parquet(self.keys).where(F.col("part").isin(parts))
        if batch is not None:
            stored = stored.where(F.col("batch") != batch)
        self.read_parts = len(parts)
        on = [F.col(f"own.{k}").eqNullSafe(F.col(f"stored.{k}")) for k in self.pk]
        return maybe.drop("part").alias("own").join(stored.alias("stored"), on, "left_semi")

    def add(self, df: DataFrame, batch: int) -> None:
        """Note the keys of a batch; a replay of the batch writes the same again."""
        own = df.select(*self.pk, self._part().alias("part")).withColumn("batch", F.lit(batch).cast("long"))
        own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "part").parquet(self.keys)
        filt = key_filter(df, self.pk, self.width).withColumn("batch", F.lit(batch).cast("long"))
        filt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(self.filters)
