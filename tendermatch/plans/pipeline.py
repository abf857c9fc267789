"""Fit / transform pipeline compositions.

``fit_once`` fits numeric and categorical state on the table without its text
columns (pruned at the scan); ``preprocess`` applies everything in one plan:
categorical lookups are broadcast/shuffle joins on the same rows, numeric
transforms and text vectors projections, so no merge by key is needed. The same
function serves a batch run and every micro-batch of a stream (T1).
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendermatch.functions.numeric import null_flag
from tendermatch.operators.categorical import CategoricalModel, categorical_fit, encode_all
from tendermatch.operators.contracts import assert_pk
from tendermatch.operators.numeric import NumericModel, numeric_columns, numeric_fit
from tendermatch.operators.text import encode_texts
from tendermatch.session import materialize


@dataclass
class FittedPipeline:
    pk: list
    numeric: NumericModel
    categorical: CategoricalModel
    text_config: dict

    @property
    def numeric_cols(self) -> list[str]:
        return list(self.numeric.stats)

    @property
    def categorical_cols(self) -> list[str]:
        return list(self.categorical.info)

    def numeric_flags(self) -> list[str]:
        return [f"{c}_is_null" for c in self.numeric_cols if self.numeric.config[c].get("add_flag", False)]


def fit_once(df: DataFrame, pk: list, numeric_cfg: dict, categorical_cfg: dict, text_cfg: dict | None = None
             ) -> FittedPipeline:
    """Fit numeric + categorical state once; text columns are not read."""
    text_cfg = text_cfg or {}
    base = df.select(*pk, *[c for c in df.columns if c in numeric_cfg or c in categorical_cfg])
    base = materialize(base)     # read by both fits
    # The two fits are independent small-job chains: submit them concurrently
    # so their stages share the cluster instead of queueing one after another.
    with ThreadPoolExecutor(max_workers=2) as pool:
        num_f = pool.submit(numeric_fit, base.select(*pk, *[c for c in base.columns if c in numeric_cfg]),
                            numeric_cfg, pk)
        cat_f = pool.submit(categorical_fit, base.select(*pk, *[c for c in base.columns if c in categorical_cfg]),
                            categorical_cfg, pk)
        num, cat = num_f.result(), cat_f.result()
    base.unpersist()
    return FittedPipeline(list(pk), num, cat, text_cfg)


def preprocess(df: DataFrame, fitted: FittedPipeline, validate: bool = True) -> DataFrame:
    """PK, numeric values, numeric flags, categorical indices, categorical flags, text vectors.

    Everything happens on the rows themselves (lookup joins and projections), so
    there is nothing to merge by key; ``validate`` checks that the key is a key.
    """
    pk = fitted.pk
    num_cols = [c for c in fitted.numeric_cols if c in df.columns]
    cat_cols = [c for c in fitted.categorical_cols if c in df.columns]
    text_cols = [c for c in fitted.text_config if c in df.columns]
    if text_cols and validate:
        assert_pk(df.select(*pk), pk)
    out = encode_all(df, cat_cols, fitted.categorical).select(
        *pk,
        *[numeric_columns(fitted.numeric, c).alias(c) for c in num_cols],
        *[null_flag(c).alias(f"{c}_is_null") for c in num_cols if fitted.numeric.config[c].get("add_flag", False)],
        *[F.col(f"_enc_{c}").alias(c) for c in cat_cols],
        *[null_flag(c).alias(f"{c}_is_null") for c in cat_cols],
        *text_cols,
    )
    return encode_texts(out, {c: fitted.text_config[c] for c in text_cols})


def run_pipeline(df: DataFrame, pk: list, numeric_cfg: dict, categorical_cfg: dict, text_cfg: dict | None,
                 sink, mode: str = "overwrite") -> FittedPipeline:
    """Fit once, transform everything, write once (the sink decides the format)."""
    fitted = fit_once(df, pk, numeric_cfg, categorical_cfg, text_cfg)
    sink(preprocess(df, fitted), mode)
    return fitted
