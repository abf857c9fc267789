"""Feature store (B1-B3, B15, B16; V16, V17).

One row per entity: ``key`` struct of the PK, ``numeric`` array<float>,
``categorical`` array<bigint>, ``text`` map<string, array<float>> with NULL
vectors zero-filled. Slicing is an equi join on the key, never a row index.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendermatch.functions.vectors import concat_dense, zero_fill
from tendermatch.operators.contracts import assert_pk


def build_store(df: DataFrame, pk: Sequence[str], numeric: Sequence[str], categorical: Sequence[str],
                text: Sequence[str] = (), text_dim: int = 768, where=None, order_limit: int | None = None,
                check_unique: bool = False) -> DataFrame:
    """B1 / B2: build the store, optionally filtered (pushed to the scan) and limited in key order."""
    src = df.where(where) if where is not None else df
    if check_unique:
        assert_pk(src, pk)
    cols = [F.struct(*[F.col(k) for k in pk]).alias("key"), *[F.col(k) for k in pk],
            F.array(*[F.col(c).cast("float") for c in numeric]).alias("numeric"),
            F.array(*[F.col(c).cast("long") for c in categorical]).alias("categorical")]
    if text:
        items = []
        for c in text:
            items += [F.lit(c), zero_fill(c, text_dim)]
        cols.append(F.create_map(*items).alias("text"))
    else:
        cols.append(F.create_map().cast("map<string,array<float>>").alias("text"))
    out = src.select(*cols)
    if order_limit:
        out = out.orderBy(*pk).limit(order_limit)
    return out


def slice_store(store: DataFrame, ids: DataFrame, pk: Sequence[str], text_cols: Sequence[str] = (),
                fused: bool = True) -> DataFrame:
    """Rows for the given ids (all rows when ids is None) -> dense (+ text) and jagged inputs."""
    s = store if ids is None else store.join(ids.select(*pk).distinct(), list(pk), "left_semi")
    vecs = [F.col("text")[c] for c in text_cols]
    dense = concat_dense(F.col("numeric"), *vecs) if fused else F.col("numeric")
    return s.select(*pk, dense.alias("dense"), F.col("categorical"),
                    *([] if fused else [F.col("text")[c].alias(c) for c in text_cols]))


def store_summary(store: DataFrame, col: str = "numeric") -> DataFrame:
    """Per position of a dense array: count, min, max, mean (plus the row count)."""
    ex = store.select(F.posexplode(col).alias("pos", "v"))
    return ex.groupBy("pos").agg(F.count("v").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"),
                                 F.avg("v").alias("mean"))
