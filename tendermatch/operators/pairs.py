"""Pairs, splits and batches.

Every limit, split and batch is defined by an explicit total order, so the
result does not depend on partitioning or re-execution:

* shuffle order = ``md5(id || '|' || seed)`` then id (L5): reproducible on any
  cluster, and the same function exists in SQL engines;
* global positions come from the distributed running index
  (``ranking.with_row_index``), never from a single-partition window.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendermatch.operators.ranking import with_row_index


def shuffle_key(id_col: str, seed: int) -> Column:
    """Seeded hash order key."""
    return F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed))))


def load_pairs(pairs: DataFrame, cols: Sequence[str], id_col: str = "id", limit: int | None = None) -> DataFrame:
    """The pair key columns, first ``limit`` by id (the limit always has an order)."""
    out = pairs.select(id_col, *cols)
    return out.orderBy(id_col).limit(limit) if limit else out


def pair_keys(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct key tuples of one side; a tuple with a NULL part is no key."""
    return pairs.select(*keys).dropna("any").distinct()


def split(pairs: DataFrame, test_split: float, id_col: str = "id", seed: int | None = None, mode: str = "head",
          dense_ids: bool = False) -> DataFrame:
    """Add ``split`` in {'train', 'test'}.

    * head:     n_test = int(n * f) rows first in (shuffled) order are test;
    * random:   n_test = ceil(n * f) (train_test_split rounding), shuffled;
    * id_range: test = first n_test ids; ``dense_ids`` reproduces the
                [min_id, min_id + n_test - 1] value range of the original.
    """
    if not 0.0 <= test_split < 1.0:
        raise ValueError("test_split must be in [0, 1)")
    if test_split == 0:
        return pairs.withColumn("split", F.lit("train"))
    n = pairs.count()
    n_test = math.ceil(n * test_split) if mode == "random" else int(n * test_split)
    if mode == "id_range" and dense_ids:
        lo = pairs.agg(F.min(id_col)).collect()[0][0]
        return pairs.withColumn("split", F.when(F.col(id_col) <= lo + n_test - 1, "test").otherwise("train"))
    if mode in ("head", "random") and seed is not None:
        order = [shuffle_key(id_col, seed), F.col(id_col)]
    else:
        order = [F.col(id_col)]
    idx = with_row_index(pairs, order, name="_tm_split_idx")
    return idx.withColumn("split", F.when(F.col("_tm_split_idx") < n_test, "test").otherwise("train")
                          ).drop("_tm_split_idx")


def with_batches(df: DataFrame, order_by: Sequence[str | Column], batch_size: int, group_by: Sequence[str] = (),
                 batch_col: str = "batch_id", pos_col: str = "pos") -> DataFrame:
    """Consecutive batches of ``batch_size`` in a total order; the last may be short."""
    idx = with_row_index(df, order_by, group_by=group_by, name="_tm_bidx")
    return (idx.withColumn(batch_col, F.floor(F.col("_tm_bidx") / batch_size).cast("long"))
            .withColumn(pos_col, (F.col("_tm_bidx") % batch_size).cast("int")).drop("_tm_bidx"))


def selective_features(store: DataFrame, pairs: DataFrame, keys: Sequence[str],
                       pair_keys_: Sequence[str] | None = None) -> DataFrame:
    """only the store rows whose key occurs in the pairs (distinct keys + semi join)."""
    pk = list(pair_keys_ or keys)
    wanted = pairs.select(*[F.col(a).alias(b) for a, b in zip(pk, keys)]).distinct()
    return store.join(wanted, list(keys), "left_semi")


def pair_features(pairs: DataFrame, notice_store: DataFrame, company_store: DataFrame, notice_pk: Sequence[str],
                  company_pk: Sequence[str], strict: bool = True) -> DataFrame:
    """Attach both sides' features to every pair.

    strict: a pair whose key is missing from a store fails the job, whatever is
    read of the result (the check is a filter above the joins, so that neither a
    count nor a projection prunes it); non-strict keeps only complete pairs.
    """
    how = "left" if strict else "inner"
    out = (pairs.join(notice_store.withColumn("_tm_has_notice", F.lit(True)), list(notice_pk), how)
           .join(company_store.withColumn("_tm_has_company", F.lit(True)), list(company_pk), how))
    marks = ["_tm_has_notice", "_tm_has_company"]
    if strict:
        complete = F.col(marks[0]).isNotNull() & F.col(marks[1]).isNotNull()
        key = F.concat_ws(", ", *[F.col(c).cast("string") for c in dict.fromkeys([*notice_pk, *company_pk])])
        problem = F.raise_error(F.concat(F.lit("pair references a key missing from a feature store: "), key))
        out = out.where(F.when(complete, F.lit(True)).otherwise(problem.cast("boolean")))
    return out.drop(*marks)


def pair_subset_bundle(pairs: DataFrame, notice_store: DataFrame, company_store: DataFrame,
                       notice_pk: Sequence[str], company_pk: Sequence[str], limit: int, test_split: float,
                       batch_size: int, seed: int = 42, id_col: str = "id") -> DataFrame:
    """First ``limit`` pairs -> their features only -> random split -> batches per split."""
    sub = pairs.orderBy(id_col).limit(limit)
    notices = rows_of(notice_store, sub, notice_pk)
    companies = rows_of(company_store, sub, company_pk)
    feats = pair_features(sub, notices, companies, notice_pk, company_pk, strict=True)
    sp = split(feats, test_split, id_col=id_col, seed=seed, mode="random")
    return with_batches(sp, [shuffle_key(id_col, seed), F.col(id_col)], batch_size, group_by=["split"])


def training_batches(pairs: DataFrame, notice_store: DataFrame, company_store: DataFrame, notice_pk: Sequence[str],
                     company_pk: Sequence[str], notice_keys: Sequence[str], company_keys: Sequence[str], batch_size: int,
                     seed: int = 42, selective: bool = False, id_col: str = "id") -> DataFrame:
    """Pairs -> seeded shuffle -> batches -> both sides' features (``dense`` and ``categorical`` columns of the
    stores) -> collated rows, one per batch. Ids and keys alone are shuffled and numbered; the features join them once
    their batch is known. ``selective`` first narrows the stores to the keys of the pairs, for few pairs against large
    stores; the batches are the same."""
    from tendermatch.operators.jagged import collate

    if selective:
        notice_store, company_store = rows_of(notice_store, pairs, notice_pk), rows_of(company_store, pairs, company_pk)
    sides = [s.select(*pk, F.col("numeric").alias(f"{name}_dense"), F.col("categorical").alias(f"{name}_cat"))
             for s, pk, name in ((notice_store, notice_pk, "notice"), (company_store, company_pk, "company"))]
    keys = list(dict.fromkeys([id_col, *notice_pk, *company_pk]))
    batched = with_batches(pairs.select(*keys), [shuffle_key(id_col, seed), F.col(id_col)], batch_size)
    joined = pair_features(batched, *sides, notice_pk, company_pk)
    return collate(joined, "notice_dense", "notice_cat", "company_dense", "company_cat", notice_keys, company_keys)


def rows_of(store: DataFrame, pairs: DataFrame, pk: Sequence[str]) -> DataFrame:
    return selective_features(store, pairs, pk)
