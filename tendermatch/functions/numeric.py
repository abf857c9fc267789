"""Numeric column expressions (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_double(c: str | Column) -> Column:
    """V1: coerce to double; unparsable -> NULL and NaN -> NULL (one missing notion)."""
    v = _c(c).try_cast("double")
    return F.when(~F.isnan(v), v)


def null_flag(c: str | Column) -> Column:
    """V2 / V8: 1.0 where the raw value is NULL (or NaN), as float32."""
    col = _c(c)
    nan = F.coalesce(F.isnan(col.try_cast("double")), F.lit(False))
    return (col.isNull() | nan).cast("float")


def clip(c: str | Column, lo: float | Column, hi: float | Column) -> Column:
    """V3: least(greatest(c, lo), hi); NULL stays NULL."""
    col = _c(c)
    return F.when(col.isNotNull(), F.least(F.greatest(col, F.lit(lo)), F.lit(hi)))


def clip_or_fill(c: str | Column, lo: float, hi: float, fill: float | None) -> Column:
    """V4: out-of-range values are replaced by the fill value."""
    col = _c(c)
    return F.when(col.between(F.lit(lo), F.lit(hi)) | col.isNull(), col).otherwise(F.lit(fill).cast("double"))


def out_of_range_to_null(c: str | Column, lo: float | Column, hi: float | Column) -> Column:
    col = _c(c)
    return F.when(col.between(F.lit(lo), F.lit(hi)), col)


def log1p_offset(c: str | Column, offset: float) -> Column:
    """V5: log1p(c + offset); arguments <= -1 give NULL."""
    return F.log1p(_c(c) + F.lit(float(offset)))


def zscore(c: str | Column, mean: float | None, std: float | None) -> Column:
    """V6: (c - mean) / std."""
    return (_c(c) - F.lit(mean).cast("double")) / F.lit(std).cast("double")


def minmax(c: str | Column, lo: float | None, hi: float | None) -> Column:
    """V6: (c - min) / (max - min)."""
    return (_c(c) - F.lit(lo).cast("double")) / (F.lit(hi).cast("double") - F.lit(lo).cast("double"))


def clamp_index(c: str | Column, size: int | Column) -> Column:
    """Clamp an index into [0, size-1]."""
    s = F.lit(size) if isinstance(size, int) else size
    return F.least(F.greatest(_c(c), F.lit(0)), s - 1)


def z_gap(gap: str | Column, neg: str | Column) -> Column:
    """Gap / max(|neg| + 1e-8, 1e-8)."""
    return _c(gap) / F.greatest(F.abs(_c(neg)) + F.lit(1e-8), F.lit(1e-8))


def round6(c: str | Column, digits: int = 6) -> Column:
    """Parity rounding used by query outputs: double, rounded, no negative zero."""
    return F.round(_c(c).cast("double"), digits) + F.lit(0.0)
