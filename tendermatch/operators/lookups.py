"""Key lookups, joins, listings and paging.

Lookups by a list of keys are semi joins against a key DataFrame (never SQL
strings with OR lists); Spark picks the join from the sizes. Listings with a limit become
``TakeOrderedAndProject`` (per-task top-n, then a merge of n rows per task).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendermatch.operators.ranking import with_row_index


def select_except(df: DataFrame, exclude: Sequence[str]) -> DataFrame:
    """every column except the given ones."""
    return df.drop(*exclude)


def select_pk_and_text(df: DataFrame, pk: Sequence[str], text_col: str) -> DataFrame:
    """F2."""
    return df.select(*pk, text_col)


def use_columns(df: DataFrame, use: Sequence[str] | None) -> DataFrame:
    """M5: project to the configured use columns; all columns when none are configured. Unknown columns are an error."""
    if not use:
        return df
    unknown = [c for c in use if c not in df.columns]
    if unknown:
        raise ValueError(f"configured columns that the table lacks: {unknown}")
    return df.select(*use)


def _check_keys(keys: DataFrame, pk: Sequence[str]) -> None:
    missing = [k for k in pk if k not in keys.columns]
    if missing:
        raise ValueError(f"key frame lacks primary key columns {missing}")


def rows_by_keys(df: DataFrame, keys: DataFrame, pk: Sequence[str], columns: Sequence[str] | None = None
                 ) -> DataFrame:
    """rows whose (composite) key is in ``keys``; set semantics on the keys."""
    _check_keys(keys, pk)
    out = df.join(keys.select(*pk).distinct(), list(pk), "left_semi")
    return out.select(*columns) if columns else out


def rows_by_keys_numeric(df: DataFrame, keys: DataFrame, pk: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """F8: like rows_by_keys, but the ``numeric`` key parts compare as integers ('000' == '0')."""
    _check_keys(keys, pk)

    def norm(frame: DataFrame, suffix: str) -> DataFrame:
        return frame.select("*", *[(F.col(k).try_cast("long") if k in numeric else F.col(k)).alias(f"{k}{suffix}")
                                   for k in pk])
    k = norm(keys.select(*pk).distinct(), "__k").select(*[f"{c}__k" for c in pk]).distinct()
    d = norm(df, "__d")
    cond = [F.col(f"{c}__d") == F.col(f"{c}__k") for c in pk]
    out = d.join(k, cond, "left_semi")
    return out.drop(*[f"{c}__d" for c in pk])


def bids_by_notices(bids: DataFrame, keys: DataFrame, notice_pk: Sequence[str]) -> DataFrame:
    """bids whose notice part of the key is requested."""
    return rows_by_keys(bids, keys, notice_pk)


def filter_order_limit(df: DataFrame, where: str | Column | None = None, order_by: Sequence[str | Column] = (),
                       limit=None, columns: Sequence[str] | None = None) -> DataFrame:
    """ad-hoc where / order / limit; a limit <= 0 or non-int is ignored."""
    out = use_columns(df, columns)
    if where is not None:
        out = out.where(where)
    if order_by:
        out = out.orderBy(*order_by)
    if isinstance(limit, int) and not isinstance(limit, bool) and limit > 0:
        out = out.limit(limit)
    return out


def id_range(df: DataFrame, col: str, lo, hi) -> DataFrame:
    """inclusive range filter (pushed to the scan)."""
    return df.where(F.col(col).between(lo, hi))


def normalize_pk(df: DataFrame, pk: Sequence[str]) -> DataFrame:
    """keys to string, NULL -> '' (run pk_violations first: this hides NULL keys)."""
    return df.select(*[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) if k in pk else F.col(k)
                       for k in df.columns])


def distinct_non_null(df: DataFrame, col: str) -> DataFrame:
    """F12 / L10."""
    return df.select(col).where(F.col(col).isNotNull()).distinct()


def bid_participants(bids: DataFrame, companies: DataFrame, keys: DataFrame, notice_pk: Sequence[str],
                     company_key: str = "bizno") -> DataFrame:
    """Companies that bid on the requested notices; unmatched bids give NULL company columns."""
    b = bids_by_notices(bids, keys, notice_pk).select(*notice_pk, company_key)
    comp_cols = [c for c in companies.columns if c != company_key]
    return b.join(companies, company_key, "left").select(*notice_pk, company_key, *comp_cols)


def bid_history(bids: DataFrame, notices: DataFrame, companies_wanted: DataFrame, notice_pk: Sequence[str],
                order_col: str, limit: int = 100, company_key: str = "bizno",
                tiebreak: Sequence[str] = ()) -> DataFrame:
    """Per requested company, its bids joined to the notice, newest first, top ``limit``.

    Newest first puts NULL registration times first (PostgreSQL DESC); ties
    break on the notice key. The per-company top-n is a window on (company)
    ordered by time: it keeps only ``limit`` rows per company.
    """
    from pyspark.sql import Window

    b = bids.join(companies_wanted.select(company_key).distinct(), company_key, "left_semi")
    j = b.join(notices, list(notice_pk), "left")
    w = Window.partitionBy(company_key).orderBy(F.col(order_col).desc_nulls_first(), *notice_pk, *tiebreak)
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def notice_bundle(notices: DataFrame, bids: DataFrame, companies: DataFrame, keys: DataFrame,
                  notice_pk: Sequence[str], company_key: str = "bizno") -> dict[str, DataFrame]:
    """Requested notices, their bids, and the companies that bid (set semantics)."""
    k = keys.select(*notice_pk).distinct()
    n = rows_by_keys(notices, k, notice_pk)
    b = rows_by_keys(bids, k, notice_pk)
    c = companies.join(b.select(company_key).where(F.col(company_key).isNotNull()).distinct(), company_key,
                       "left_semi")
    return {"notice": n, "bid": b, "company": c}


def recent(df: DataFrame, ts_col: str, pk: Sequence[str], limit: int = 100) -> DataFrame:
    """L1: newest ``limit`` rows, NULL times first, ties on the key."""
    return df.orderBy(F.col(ts_col).desc_nulls_first(), *pk).limit(limit)


def page(df: DataFrame, order_by: Sequence[str], offset: int, limit: int) -> DataFrame:
    """One page, in a total order (order keys must be unique).

    Rows are numbered by the distributed row index, so that a deep page costs
    what the first one does; the page's rows come in order.
    """
    idx = with_row_index(df, order_by, name="_tm_page_idx")
    return idx.where(F.col("_tm_page_idx").between(offset, offset + limit - 1)).orderBy("_tm_page_idx").drop("_tm_page_idx")


def row_count(df: DataFrame) -> int:
    """S3: counts raise on error (no silent zero)."""
    return df.count()


def id_stats(pairs: DataFrame, id_col: str = "id", limit: int | None = None) -> DataFrame:
    """Count, min id, max id, optionally over the first ``limit`` ids."""
    src = pairs.select(id_col)
    if limit:
        src = src.orderBy(id_col).limit(limit)
    return src.agg(F.count(F.lit(1)).alias("total_count"), F.min(id_col).alias("min_id"),
                   F.max(id_col).alias("max_id"))
