"""Jagged (keys, values, lengths) packing for batches.

A batch is bounded by the batch size, so packing a batch into one row with
``collect_list`` is bounded too (B rows x K keys). Row order inside a batch is
restored by sorting the collected (pos, ...) structs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendermatch.functions.numeric import clamp_index

def _rows(batched: DataFrame, cols: Sequence[str], batch_col: str, pos_col: str) -> DataFrame:
    # sort_array compares structs itself; array_sort would run a lambda for each comparison
    return batched.groupBy(batch_col).agg(
        F.sort_array(F.collect_list(F.struct(F.col(pos_col).alias("pos"), *[F.col(c) for c in cols]))).alias("_rows"))


def pack(batched: DataFrame, keys: Sequence[str], values_col: str = "categorical", layout: str = "row_major",
         batch_col: str = "batch_id", pos_col: str = "pos") -> DataFrame:
    """B4 (row-major: row0 k0..kK, row1 ...) / B5 (key-major: k0 row0..rowB, k1 ...): one value per key."""
    g = _rows(batched, [values_col], batch_col, pos_col)
    k = len(keys)
    if layout == "row_major":
        values = F.flatten(F.transform("_rows", lambda r: r[values_col]))
    elif layout == "key_major":
        values = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(k - 1)),
                                       lambda i: F.transform("_rows", lambda r: r[values_col][i])))
    else:
        raise ValueError("layout must be row_major or key_major")
    n = F.size("_rows")
    jag = F.struct(F.array(*[F.lit(x) for x in keys]).alias("keys"), values.cast("array<bigint>").alias("values"),
                   F.array_repeat(F.lit(1), n * k).alias("lengths"))
    return g.select(batch_col, n.alias("batch_rows"), jag.alias("jagged"))


def pack_multi(batched: DataFrame, features: Sequence[str], batch_col: str = "batch_id", pos_col: str = "pos"
               ) -> DataFrame:
    """Multi-valued features, key-major; an absent (NULL) feature has length 0."""
    g = _rows(batched, features, batch_col, pos_col)
    def values_of(f):
        return lambda r: F.coalesce(r[f].cast("array<bigint>"), F.array().cast("array<bigint>"))

    def length_of(f):
        return lambda r: F.when(r[f].isNull(), F.lit(0)).otherwise(F.size(r[f])).cast("int")

    vals = [F.flatten(F.transform("_rows", values_of(f))) for f in features]
    lens = [F.transform("_rows", length_of(f)) for f in features]
    jag = F.struct(F.array(*[F.lit(x) for x in features]).alias("keys"),
                   F.flatten(F.array(*vals)).cast("array<bigint>").alias("values"),
                   F.flatten(F.array(*lens)).alias("lengths"))
    return g.select(batch_col, F.size("_rows").alias("batch_rows"), jag.alias("jagged"))


def unpack(packed: DataFrame, vocab_sizes: dict[str, int] | None = None, batch_col: str = "batch_id") -> DataFrame:
    """B7 (row-major, one value per key): (batch, row, key, index) with the index clamped."""
    ex = packed.select(batch_col, F.col("jagged.keys").alias("keys"),
                       F.posexplode("jagged.values").alias("p", "v"))
    k = F.size("keys")
    out = ex.select(batch_col, F.floor(F.col("p") / k).cast("int").alias("row"), (F.col("p") % k).alias("key_pos"),
                    F.col("keys")[F.col("p") % k].alias("key"), F.col("v"))
    if vocab_sizes:
        size = F.create_map(*[x for kv in vocab_sizes.items() for x in (F.lit(kv[0]), F.lit(int(kv[1])))])
        out = out.withColumn("v", F.when(size[F.col("key")].isNotNull(),
                                         clamp_index(F.col("v"), size[F.col("key")])).otherwise(F.col("v")))
    return out.withColumnRenamed("v", "idx")


def combine(packed: DataFrame, group_col: str, order_col: str) -> DataFrame:
    """Concatenate packed samples of a group in order (keys of the first sample)."""
    g = packed.groupBy(group_col).agg(F.sort_array(F.collect_list(F.struct(F.col(order_col).alias("o"),
                                                                            F.col("jagged").alias("j")))).alias("_s"))
    return g.select(group_col, F.struct(
        F.col("_s")[0]["j"]["keys"].alias("keys"),
        F.flatten(F.transform("_s", lambda s: s["j"]["values"])).alias("values"),
        F.flatten(F.transform("_s", lambda s: s["j"]["lengths"])).alias("lengths")).alias("jagged"))


def collate(batched_pairs: DataFrame, notice_dense: str, notice_cat: str, company_dense: str, company_cat: str,
            notice_keys: Sequence[str], company_keys: Sequence[str], batch_col: str = "batch_id",
            pos_col: str = "pos") -> DataFrame:
    """Per batch, dense rows and row-major jagged categorical inputs for both sides."""
    g = _rows(batched_pairs, [notice_dense, notice_cat, company_dense, company_cat], batch_col, pos_col)

    def side(dense, cat, keys):
        return F.struct(F.transform("_rows", lambda r: r[dense]).alias("dense"),
                        F.struct(F.array(*[F.lit(x) for x in keys]).alias("keys"),
                                 F.flatten(F.transform("_rows", lambda r: r[cat])).cast("array<bigint>").alias("values"),
                                 F.array_repeat(F.lit(1), F.size("_rows") * len(keys)).alias("lengths")).alias("kjt"))
    return g.select(batch_col, F.size("_rows").alias("batch_rows"),
                    side(notice_dense, notice_cat, notice_keys).alias("notice"),
                    side(company_dense, company_cat, company_keys).alias("company"))
