"""Distributed scoring with given weights.

Weights are inputs (the reference never trains its projectors; see Q11).
They are shipped once per executor with a broadcast variable; each Arrow batch
of rows is scored with NumPy matmuls inside ``mapInPandas`` (inference mode:
BatchNorm uses running statistics, dropout is the identity).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Layer:
    w: np.ndarray                 # [in, out]
    b: np.ndarray                 # [out]
    relu: bool = False
    bn: tuple | None = None       # (gamma, beta, running_mean, running_var, eps), applied after ReLU


@dataclass
class TowerWeights:
    dense: Layer                                   # dense projection of the numeric (+ text) input
    embeddings: list = field(default_factory=list)  # one [vocab, dim] table per categorical key
    mlp: list = field(default_factory=list)         # hidden layers
    final: Layer | None = None
    normalize: bool = True


def _plain(layer: Layer | dict) -> dict:
    """Layers travel to executors as plain dicts of arrays (broadcast values are pickled by reference)."""
    if isinstance(layer, dict):
        return layer
    return {"w": np.asarray(layer.w, dtype=np.float64), "b": np.asarray(layer.b, dtype=np.float64),
            "relu": bool(layer.relu), "bn": None if layer.bn is None else tuple(np.asarray(v) for v in layer.bn)}


def apply_layers(x: np.ndarray, layers: Sequence[Layer | dict]) -> np.ndarray:
    for layer in map(_plain, layers):
        x = x @ layer["w"] + layer["b"]
        if layer["relu"]:
            x = np.maximum(x, 0.0)
        if layer["bn"] is not None:
            g, beta, rm, rv, eps = layer["bn"]
            x = (x - rm) / np.sqrt(rv + eps) * g + beta
    return x


def _matrix(s: pd.Series, width: int, missing: float, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Array column as a matrix, and which rows have one; another width is an error."""
    present = s.notna().to_numpy()
    out = np.full((len(s), width), missing, dtype=dtype)
    if present.any():
        rows = s[present].to_numpy()
        sizes = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
        if (sizes != width).any():
            raise ValueError(f"vectors of width {sorted(set(sizes.tolist()))} where {width} is needed")
        out[present] = np.concatenate(rows).reshape(-1, width)
    return out, present


def _stack(s: pd.Series, dim: int) -> np.ndarray:
    """Rows without a vector score as zeros."""
    return _matrix(s, dim, 0.0, np.float64)[0]


def project(df: DataFrame, keys: Sequence[str], col: str, layers: Sequence[Layer], out: str = "projected"
            ) -> DataFrame:
    """Linear -> ReLU -> Linear (any stack of layers) applied to an array column."""
    bc = df.sparkSession.sparkContext.broadcast([_plain(x) for x in layers])
    dim_in = _plain(layers[0])["w"].shape[0]
    keys = list(keys)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ls = bc.value
        for pdf in it:
            y = apply_layers(_stack(pdf[col], dim_in), ls).astype(np.float32)
            res = pdf[keys].copy()
            res[out] = list(y)
            yield res
    schema = ", ".join(f"`{k}` {t}" for k, t in df.select(*keys).dtypes) + f", `{out}` array<float>"
    return df.select(*keys, col).mapInPandas(run, schema)


def tower_scores(df: DataFrame, keys: Sequence[str], dense_col: str, cat_col: str | None, weights: TowerWeights,
                 out: str = "embedding") -> DataFrame:
    """Dense projection ++ categorical embeddings -> MLP -> final linear -> L2 normalise.

    Categorical indices are clamped into each table (V21); a missing index
    array embeds to zeros (B12).
    """
    bc = df.sparkSession.sparkContext.broadcast({
        "dense": _plain(weights.dense), "embeddings": [np.asarray(t) for t in weights.embeddings],
        "mlp": [_plain(x) for x in weights.mlp], "final": None if weights.final is None else _plain(weights.final),
        "normalize": bool(weights.normalize)})
    keys = list(keys)
    dim_in = _plain(weights.dense)["w"].shape[0]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = bc.value
        for pdf in it:
            x = apply_layers(_stack(pdf[dense_col], dim_in), [w["dense"]])
            parts = [x]
            if cat_col is not None and w["embeddings"]:
                n_keys = len(w["embeddings"])
                idx, present = _matrix(pdf[cat_col], n_keys, 0, np.int64)
                for k, table in enumerate(w["embeddings"]):
                    emb = table[np.clip(idx[:, k], 0, table.shape[0] - 1)]      # clamp (V21)
                    parts.append(np.where(present[:, None], emb, 0.0))      # missing -> zeros
            h = apply_layers(np.concatenate(parts, axis=1), w["mlp"])
            if w["final"] is not None:
                h = apply_layers(h, [w["final"]])
            if w["normalize"]:
                h = h / np.maximum(np.linalg.norm(h, axis=1, keepdims=True), 1e-12)
            res = pdf[keys].copy()
            res[out] = list(h.astype(np.float32))
            yield res
    cols = [dense_col] + ([cat_col] if cat_col else [])
    schema = ", ".join(f"`{k}` {t}" for k, t in df.select(*keys).dtypes) + f", `{out}` array<float>"
    return df.select(*keys, *cols).mapInPandas(run, schema)


def embed_categorical(df: DataFrame, id_cols: Sequence[str], cat_col: str, tables: DataFrame, dim: int,
                      n_keys: int) -> DataFrame:
    """J10 / B12 as joins: (key_pos, idx) -> vec, one lookup per key, concatenated in key order.

    A row is kept whatever it lacks: a missing array, a NULL or unknown index
    and a short array give zeros in their places.
    """
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
    out = df.select(*id_cols, F.col(cat_col).alias("_tm_cat"))
    for k in range(n_keys):
        own = tables.where(F.col("key_pos") == k).select(F.col("idx").alias(f"_tm_i{k}"), F.col("vec").cast("array<float>").alias(f"_tm_v{k}"))
        out = out.join(own, F.get("_tm_cat", F.lit(k)) == F.col(f"_tm_i{k}"), "left").drop(f"_tm_i{k}")
    return out.select(*id_cols, F.concat(*[F.coalesce(f"_tm_v{k}", zeros) for k in range(n_keys)]).alias("cat_embedding"))


def pair_scores(pairs: DataFrame, notice_emb: DataFrame, company_emb: DataFrame, notice_pk: Sequence[str],
                company_pk: Sequence[str], temperature: float = 1.0) -> DataFrame:
    """Score each pair by the dot product of its two tower embeddings."""
    from tendermatch.functions.vectors import dot

    n = notice_emb.withColumnRenamed("embedding", "notice_embedding")
    c = company_emb.withColumnRenamed("embedding", "company_embedding")
    j = pairs.join(n, list(notice_pk), "inner")
    j = j.join(c, list(company_pk), "inner")
    return j.withColumn("score", dot("notice_embedding", "company_embedding") / F.lit(float(temperature)))
