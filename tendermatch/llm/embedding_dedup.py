"""Operator 7: embedding near-duplicates by a pivot-permutation index.

Vectors are described by their nearest reference points (pivots) in order.
Every vector enters the inverted lists of its pivots; two vectors meet in the
lists that they share, the number of shared pivots is counted, and the cosine
of those with enough of them is verified in double precision. A pair counts in
the first list that it shares only.

Equal vectors are one entry with a weight. A long list is cut into blocks, and
pairs of blocks are compared in separate tasks. No pair is ever written: a
task gives, for each of its vectors, the weight of its partners and the
smallest vector that it reaches inside the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendermatch.llm.common import pin
from tendermatch.llm.graph import components

THRESHOLD = 0.95
NEAREST = 8               # pivots that describe a vector
MIN_SHARED = 1            # pivots that a pair must share
MIN_PIVOTS, MAX_PIVOTS = 16, 4096
SAMPLE = 4                # vectors looked at per pivot
APART = 0.6               # pivots have a cosine below this, so that a dense group does not hold many of them
BLOCK = 2048              # vectors of a list that one task compares with as many others
STRIPE = 256              # rows of a block compared at once


def n_pivots(n: int) -> int:
    """A power of two near twice the root of the number of vectors, within bounds."""
    return int(np.clip(2 ** np.ceil(np.log2(2 * max(1, n) ** 0.5)), MIN_PIVOTS, MAX_PIVOTS))


def choose_pivots(unit: np.ndarray, most: int, apart: float = APART) -> np.ndarray:
    """The first ``most`` rows that are not near a row chosen before."""
    chosen = np.zeros((min(most, len(unit)), unit.shape[1] if unit.ndim == 2 else 1))
    n = 0
    for row in unit:
        if n == len(chosen):
            break
        if not n or (chosen[:n] @ row).max() < apart:
            chosen[n] = row
            n += 1
    return chosen[:n]


def nearest_pivots(unit: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """Numbers of the nearest pivots of each row, nearest first; of equally near ones the smaller number."""
    k = min(nearest, len(pivots))
    near = unit @ pivots.T
    part = np.argpartition(-near, k - 1, axis=1)[:, :k]
    order = np.lexsort((part, -np.take_along_axis(near, part, axis=1)), axis=1)
    return np.take_along_axis(part, order, axis=1).astype(np.int32)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)         # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _roots(n: int, links: list[tuple[np.ndarray, np.ndarray]], names: np.ndarray) -> np.ndarray:
    """Smallest name that each of n entries reaches over the links."""
    root = names.copy()
    while links:
        before = root.copy()
        for a, b in links:
            least = np.minimum(root[a], root[b])
            np.minimum.at(root, a, least)
            np.minimum.at(root, b, least)
        if (root == before).all():
            break
    return root


def compare(own: pd.DataFrame, pivot: int, one: int, other: int, threshold: float, min_shared: int) -> pd.DataFrame:
    """Links between two blocks of a list (or inside one)."""
    x, lists = _unit(_matrix(own["vec"])), np.stack(own["near"].to_numpy())
    names, weight = own["cid"].to_numpy(), own["weight"].to_numpy()
    left = np.flatnonzero(own["block"].to_numpy() == one)
    right = left if one == other else np.flatnonzero(own["block"].to_numpy() == other)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    partners = np.zeros(len(own), dtype=np.int64)
    for k in range(0, len(left), STRIPE):
        rows = left[k:k + STRIPE]
        i, j = np.nonzero(x[rows] @ x[right].T >= threshold)
        a, b = rows[i], right[j]
        if one == other:
            a, b = a[i + k < j], b[i + k < j]
        for at in range(0, len(a), 100_000):
            p, q = a[at:at + 100_000], b[at:at + 100_000]
            same = lists[p][:, :, None] == lists[q][:, None, :]
            shared = same.any(axis=2)
            first = np.where(shared, lists[p], np.iinfo(np.int32).max).min(axis=1)
            good = (first == pivot) & (shared.sum(axis=1) >= min_shared)
            p, q = p[good], q[good]
            partners += np.bincount(p, weight[q], len(own)).astype(np.int64) + np.bincount(q, weight[p], len(own)).astype(np.int64)
            found.append((p, q))
    linked = partners > 0
    return pd.DataFrame({"cid": names[linked], "root": _roots(len(own), found, names)[linked], "partners": partners[linked]})


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD,
                    nearest: int = NEAREST, min_shared: int = MIN_SHARED) -> DataFrame:
    """``<id_col>, n_links, component_id, kept`` for every row of ``table``.

    Rows are linked when the cosine of their vectors is at least ``threshold``.
    A vector that is null, empty, zero or holds a null or a non-finite number
    links with nothing and is its own component. Vectors must have one width.
    Rows that share an id are one node of the graph; each of them is returned.
    A null id links with nothing and has a null component, and is kept. Other
    columns are left out; an empty table gives an empty one.
    """
    spark = table.sparkSession
    vec = F.col("vec")
    whole = (F.size(vec) > 0) & ~F.exists(vec, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) \
        & F.exists(vec, lambda v: v != 0)
    rows = table.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec"))
    rows = (rows.withColumn("good", F.coalesce(whole, F.lit(False)) & F.col("id").isNotNull())
            .withColumns({"k1": F.when(F.col("good"), F.xxhash64("vec")), "k2": F.when(F.col("good"), F.xxhash64(F.lit(1), "vec"))}))
    keyed = pin(rows.select("id", "k1", "k2", F.when(F.col("good"), F.col("vec")).alias("vec")), "vec-rows")

    # equal vectors are one entry, named by their smallest id
    entries = pin(keyed.where("k1 is not null").groupBy("k1", "k2")
                  .agg(F.min("id").alias("cid"), F.count("*").alias("weight")), "vec-entries")
    # the vector comes from one row of the smallest id
    one = keyed.where("k1 is not null").select("id", F.col("k1").alias("v1"), F.col("k2").alias("v2"), "vec")
    vectors = (entries.join(one, F.expr("id = cid and v1 = k1 and v2 = k2")).select("cid", "weight", "k1", "k2", "vec")
               .dropDuplicates(["k1", "k2"]))
    vectors = pin(vectors, "vec-vectors")
    count = vectors.count()
    wanted = n_pivots(count)
    sample = vectors.orderBy(F.xxhash64("k1", "k2"), "k1", "k2").limit(SAMPLE * wanted).select("vec").toPandas()   # bounded
    pivots = spark.sparkContext.broadcast(choose_pivots(_unit(_matrix(sample["vec"])), wanted) if len(sample) else np.zeros((0, 1)))

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                near = nearest_pivots(_unit(_matrix(batch["vec"])), pivots.value, nearest)
                batch["near"] = list(near)
                yield batch[["cid", "weight", "vec", "near"]]

    kind = keyed.schema["id"].dataType.simpleString()
    described = pin(vectors.select("cid", "weight", "vec").mapInPandas(
        describe, f"cid {kind}, weight bigint, vec array<double>, near array<int>"), "vec-described")
    posted = described.withColumn("pivot", F.explode("near"))
    sizes = posted.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))     # a row per pivot
    posted = (posted.join(F.broadcast(sizes), "pivot")
              .withColumn("block", F.pmod(F.xxhash64("cid", "weight"), F.col("blocks")).cast("int")))
    paired = (posted.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .withColumns({"one": F.least("block", "with"), "other": F.greatest("block", "with")}))

    def task(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        return compare(own, int(key[0]), int(key[1]), int(key[2]), threshold, min_shared)

    linked = pin(paired.select("pivot", "one", "other", "block", "cid", "weight", "vec", "near").groupBy("pivot", "one", "other")
                 .applyInPandas(task, f"cid {kind}, root {kind}, partners bigint"), "vec-links")

    totals = linked.groupBy("cid").agg(F.sum("partners").alias("partners"))
    named = components(linked.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    facts = pin(entries.join(totals, "cid", "left").join(named.withColumnRenamed("node", "cid"), "cid", "left")
                .select("k1", "k2", (F.col("weight") - 1 + F.coalesce("partners", F.lit(0))).alias("n_links"),
                        F.coalesce("component", "cid").alias("component_id")), "vec-facts")
    out = keyed.select("id", "k1", "k2").join(facts, ["k1", "k2"], "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                      F.coalesce("component_id", "id").alias("component_id"),
                      F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(True)).alias("kept"))
