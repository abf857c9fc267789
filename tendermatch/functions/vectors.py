"""Vector (array<float|double>) expressions: V10-V13, V16, V17, V19, V20.

All are higher-order functions evaluated inside the JVM row by row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once per row, however often ``use`` names it.

    The value becomes the variable of a lambda. An expression that is written out twice, or inside another lambda, is
    evaluated as often as it stands there; projections do not help, because the optimiser may inline them.
    """
    return F.transform(F.array(value), use)[0]


def explode_vector(df: DataFrame, keys: Sequence[str], col: str, pos: str = "pos", value: str = "value") -> DataFrame:
    """One row per element: ``keys, pos, value``; rows without a vector or with an empty one are left out.

    ``posexplode`` lets the optimiser infer ``size(col) > 0`` and push it below the projection that makes the vector,
    which then is made twice; the outer form with a filter on the position does not.
    """
    return df.select(*keys, F.posexplode_outer(col).alias(pos, value)).where(F.col(pos).isNotNull())


def dot(a: str | Column, b: str | Column) -> Column:
    """sum_i a_i * b_i (double)."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                       lambda acc, v: acc + v)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: str | Column, eps: float = 1e-12) -> Column:
    """X / max(||x||, eps)."""
    def scaled(v: Column) -> Column:
        return bind(F.greatest(norm(v), F.lit(eps)), lambda n: F.transform(v, lambda x: x.cast("double") / n))

    return bind(_c(a), scaled)


def unit_norm_check(a: str | Column, atol: float = 1e-4, rtol: float = 1e-5) -> Column:
    """|norm - 1| <= atol + rtol (torch.allclose defaults as used)."""
    return F.abs(norm(a) - F.lit(1.0)) <= F.lit(atol + rtol)


def all_finite(a: str | Column) -> Column:
    return F.forall(_c(a), lambda x: ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))) & x.isNotNull())


def zero_fill(a: str | Column, dim: int = 768) -> Column:
    """NULL vector -> zeros(dim), as float."""
    return F.coalesce(_c(a).cast("array<float>"), F.array_repeat(F.lit(0.0).cast("float"), dim))


def concat_dense(*cols: str | Column) -> Column:
    """Concatenate numeric features and vectors; all inputs NULL -> NULL."""
    parts = [_c(c).cast("array<float>") for c in cols]
    present = F.lit(False)
    for p in parts:
        present = present | p.isNotNull()
    return F.when(present, F.concat(*[F.coalesce(p, F.array().cast("array<float>")) for p in parts]))


def mean_pool(hidden: DataFrame, id_col: str, vec_col: str, mask_col: str | None = None) -> DataFrame:
    """V10 over token-level hidden states: sum(h*m) / max(sum(m), 1e-6) per id.

    Distributed: explode dimensions, partial sums per (id, dim) combined
    map-side, then rebuild the vector ordered by dimension (bounded by dim).
    """
    m = F.col(mask_col).cast("double") if mask_col else F.lit(1.0)
    ex = hidden.select(id_col, F.posexplode(vec_col).alias("dim", "h"), m.alias("m"))
    agg = ex.groupBy(id_col, "dim").agg(F.sum(F.col("h") * F.col("m")).alias("s"), F.sum("m").alias("n"))
    per = agg.select(id_col, "dim", (F.col("s") / F.greatest(F.col("n"), F.lit(1e-6))).alias("v"))
    return (per.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("dim", "v"))).alias("_p"))
            .select(id_col, F.transform("_p", lambda s: s["v"]).alias("pooled")))


def expand_vector(df: DataFrame, col: str, dim: int, drop: bool = True) -> DataFrame:
    """Vector -> columns ``{col}_emb000 ...``."""
    out = df.select("*", *[F.col(col)[i].alias(f"{col}_emb{i:03d}") for i in range(dim)])
    return out.drop(col) if drop else out


_EMB = re.compile(r"^(.+)_emb(\d{3})$")


def collapse_vectors(df: DataFrame) -> DataFrame:
    """Group ``^(.+)_emb(\\d{3})$`` columns back into vectors ordered by index;
    a vector with any non-finite element becomes NULL."""
    groups: dict[str, list[tuple[int, str]]] = {}
    keep = []
    for c in df.columns:
        m = _EMB.match(c)
        if m:
            groups.setdefault(m.group(1), []).append((int(m.group(2)), c))
        else:
            keep.append(c)
    vecs = []
    for base, parts in groups.items():
        arr = F.array(*[F.col(c).cast("double") for _, c in sorted(parts)])
        vecs.append(F.when(all_finite(arr), arr).alias(base))
    return df.select(*keep, *vecs)


def format_vector(a: str | Column, digits: int = 6) -> Column:
    """V13: '[a,b,...]' text with ``digits`` significant digits per element."""
    def sig(x: Column) -> Column:
        e = F.floor(F.log10(F.abs(x)))
        scale = (F.lit(digits - 1) - e).cast("int")
        p = F.pow(F.lit(10.0), scale)
        # explicit half-up: float32 inputs often land exactly on .5
        r = F.when(x == 0, F.lit(0.0)).otherwise(F.floor(x.cast("double") * p + 0.5) / p)
        return r.cast("string")
    return F.concat(F.lit("["), F.array_join(F.transform(_c(a), sig), ","), F.lit("]"))


def parse_vector(c: str | Column) -> Column:
    """V13 inverse: '[a,b,...]' or JSON list text -> array<double>."""
    return F.from_json(_c(c), "array<double>")
