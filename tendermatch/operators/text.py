"""Text transform (P5), vector refresh (P9 / T2 batch form) and update-by-key.

The encoder is pluggable: a function that replaces a text column of a frame by
vectors, row by row. The default is the offline hashed-token encoder
(``functions.text.hashed_embedding``): JVM-side, whole texts, no model files.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendermatch.functions.text import clean_text, hashed_embedding
from tendermatch.functions.vectors import l2_normalize

TEXT_DEFAULTS = {"lowercase": True, "strip": True, "fillna": "", "l2_normalize": True, "drop_if_empty": False}

Encoder = Callable[[DataFrame, str], DataFrame]


def encode_texts(df: DataFrame, config: dict, encoder: Encoder | None = None, dim: int = 8) -> DataFrame:
    """``df`` with every configured text column replaced by its vector (clean -> encode -> normalise).

    A projection: no key is needed, no row merges with another. Only
    ``drop_if_empty`` removes rows.
    """
    cols = [c for c in df.columns if c in config]
    encode = encoder or (lambda frame, c: hashed_embedding(frame, c, dim))
    for c in cols:
        cfg = config[c]
        df = df.withColumn(c, clean_text(c, cfg.get("strip", True), cfg.get("lowercase", True), cfg.get("fillna", "")))
        if cfg.get("drop_if_empty", False):
            df = df.where(F.length(c) > 0)
    for c in cols:
        df = encode(df, c)
        vec = l2_normalize(c) if config[c].get("l2_normalize", True) else F.col(c)
        df = df.withColumn(c, vec.cast("array<float>"))
    return df


def text_transform(df: DataFrame, pk: Sequence[str], config: dict, encoder: Encoder | None = None,
                   dim: int = 8) -> DataFrame:
    """P5: PK + one vector column per configured text column."""
    cols = [c for c in df.columns if c in config and c not in pk]
    return encode_texts(df.select(*pk, *cols), {c: config[c] for c in cols}, encoder, dim)


def update_by_key(target: DataFrame, updates: DataFrame, pk: Sequence[str], col: str) -> DataFrame:
    """Replace ``col`` of target rows whose key has an update; others keep their value.

    Unmatched updates are ignored and an update of NULL sets NULL. Two updates
    for one key are an error (they would multiply the target's rows).
    """
    repeated = updates.groupBy(*pk).count().where("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"more than one update for a key: {repeated[0].asDict()}")
    u = updates.select(*pk, F.col(col).alias("_tm_new"), F.lit(True).alias("_tm_hit"))
    j = target.join(u, list(pk), "left")
    return j.withColumn(col, F.when(F.col("_tm_hit"), F.col("_tm_new")).otherwise(F.col(col))).select(*target.columns)


def refresh_vectors(target: DataFrame, source: DataFrame, pk: Sequence[str], text_col: str, vec_col: str,
                    config: dict | None = None, encoder=None, dim: int = 8) -> DataFrame:
    """Re-embed ``text_col`` of ``source`` and write it into ``vec_col`` of ``target`` by key."""
    cfg = {text_col: {**TEXT_DEFAULTS, **(config or {})}}
    emb = text_transform(source.select(*pk, text_col), pk, cfg, encoder, dim).withColumnRenamed(text_col, vec_col)
    return update_by_key(target, emb, pk, vec_col)
