"""Numeric fit / transform (P1, P2; A1-A8; V1-V7).

Config per column (same keys as the reference's JSON configs):
``fill`` (``median`` | ``mode`` | number; anything else -> 0), ``clip``
([low_pct, high_pct]) or ``clip_abs`` ([low, high]), ``clip_to_null``,
``log1p``, ``scale`` (``zscore`` | ``minmax`` | ``none``), ``add_flag``.

Fit runs as a handful of scans of the numeric columns (pinned once) that each
cover *all* configured columns; no value is shuffled or sorted:

1. counts of values and nulls, in one aggregate;
2. the ranks of medians and percentile bounds by radix selection
   (``selection``), exact for any number of distinct values; the null count
   shifts the ranks of the *filled* distribution, so that medians and bounds
   come from the same passes;
3. modes, where configured, by counting the values of those columns;
4. the log offset from the clipped minimum;
5. mean / sample std / min / max of the pre-scaling value in one aggregate
   (sums around a shift to keep precision).

There is one way through for any number of distinct values.
Only per-column scalars travel to the driver. Transform is one ``select``.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tendermatch.functions.numeric import (clip, clip_or_fill, log1p_offset, minmax, null_flag, out_of_range_to_null,
                                           to_double, zscore)
from tendermatch.operators.selection import rank_pair, select_ranks, select_weighted_ranks
from tendermatch.session import materialize

STAT_KEYS = ("fill_value", "clip_low", "clip_high", "log1p_offset", "mean", "std", "min", "max")


@dataclass
class NumericModel:
    config: dict
    stats: dict = field(default_factory=dict)
    pk: list = field(default_factory=list)

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(c, *[None if s.get(k) is None else float(s[k]) for k in STAT_KEYS]) for c, s in self.stats.items()]
        schema = "column string, " + ", ".join(f"{k} double" for k in STAT_KEYS)
        return spark.createDataFrame(rows, schema)

    def to_json(self) -> str:
        return json.dumps({"config": self.config, "stats": self.stats, "pk": self.pk})

    @classmethod
    def from_json(cls, text: str) -> "NumericModel":
        d = json.loads(text)
        return cls(d["config"], d["stats"], d.get("pk", []))


def _fill_kind(cfg: dict):
    f = cfg.get("fill")
    if f in ("median", "mode"):
        return f
    if isinstance(f, (int, float)) and not isinstance(f, bool):
        return float(f)
    return 0.0


def value_histogram(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value, cnt) over the coerced values; the NULL value holds the null count."""
    typed = df.select(*[to_double(c).alias(c) for c in cols])
    long = typed.unpivot([], cols, "column", "value")
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt"))


def _approximate(typed: DataFrame, wanted: list[tuple[str, float]], fills: dict[str, float | None], accuracy: int
                 ) -> dict[tuple[str, float], float | None]:
    """Quantiles of the filled columns from sketches."""
    if not wanted:
        return {}
    row = typed.agg(*[F.percentile_approx(F.coalesce(F.col(c), F.lit(fills.get(c)).cast("double")), p, accuracy).alias(f"q{k}")
                      for k, (c, p) in enumerate(wanted)]).first()
    return {w: row[f"q{k}"] for k, w in enumerate(wanted)}


class _Rows:
    """What the fit asks of its columns, from rows of doubles: one aggregate over all columns for each question."""

    def __init__(self, typed: DataFrame):
        self.typed = typed

    def counts(self, names: list[str]) -> dict[str, tuple[int, int]]:
        """Values and nulls of each column."""
        row = self.typed.agg(F.count(F.lit(1)).alias("_tm_n"), *[F.count(F.col(c)).alias(c) for c in names]).first()
        return {c: (row[c], row["_tm_n"] - row[c]) for c in names}

    def modes(self, names: list[str]) -> dict[str, float]:
        return _Counted(value_histogram(self.typed, names)).modes(names)

    def ranks(self, wanted: dict[str, set[int]]) -> dict[tuple[str, int], float]:
        return select_ranks(self.typed, wanted)

    def place(self, fills: dict[str, float]) -> dict[str, tuple[int, int]]:
        """Values below and up to a number, of each column."""
        own = [F.struct(F.count(F.when(F.col(c) < f, 1)).alias("below"), F.count(F.when(F.col(c) <= f, 1)).alias("upto")).alias(c)
               for c, f in fills.items()]
        row = self.typed.agg(*own).first()
        return {c: (row[c].below, row[c].upto) for c in fills}

    def least(self, values: dict[str, Callable[[Column], Column]]) -> dict[str, float | None]:
        row = self.typed.agg(*[F.min(f(F.col(c))).alias(c) for c, f in values.items()]).first()
        return {c: row[c] for c in values}

    def moments(self, values: dict[str, Callable[[Column], Column]], shifts: dict[str, float]) -> dict[str, dict]:
        """Number, sums of the values and their squares around a shift, least and largest value."""
        shown = self.typed.select(*[f(F.col(c)).alias(c) for c, f in values.items()])
        row = shown.agg(*[_moments(F.col(c), F.lit(1), shifts[c]).alias(c) for c in values]).first()
        return {c: row[c].asDict() for c in values if row[c].n}


def _moments(x: Column, weight: Column, shift: float) -> Column:
    d, w = x - F.lit(shift), weight.cast("double")
    return F.struct(F.coalesce(F.sum(F.when(x.isNotNull(), weight)), F.lit(0)).alias("n"), F.sum(w * d).alias("s1"), F.sum(w * d * d).alias("s2"),
                    F.min(x).alias("min"), F.max(x).alias("max"))


class _Counted:
    """The same from counts ``column, value, cnt``; the null value holds the null count."""

    def __init__(self, counts: DataFrame):
        self.table = counts

    def _of(self, names) -> DataFrame:
        return self.table.where(F.col("column").isin(list(names)))

    def counts(self, names: list[str]) -> dict[str, tuple[int, int]]:
        null = F.col("value").isNull()
        got = {r["column"]: (r.n, r.z) for r in self._of(names).groupBy("column").agg(
            F.sum(F.when(null, 0).otherwise(F.col("cnt"))).alias("n"), F.sum(F.when(null, F.col("cnt")).otherwise(0)).alias("z")).collect()}
        return {c: got.get(c, (0, 0)) for c in names}

    def modes(self, names: list[str]) -> dict[str, float]:
        """Lowest value on ties."""
        return {r["column"]: r["mode"] for r in self._of(names).where("value is not null").groupBy("column")
                .agg(F.max_by("value", F.struct(F.col("cnt"), -F.col("value"))).alias("mode")).collect()}

    def ranks(self, wanted: dict[str, set[int]]) -> dict[tuple[str, int], float]:
        return select_weighted_ranks(self.table, wanted)

    def place(self, fills: dict[str, float]) -> dict[str, tuple[int, int]]:
        fill = F.coalesce(*[F.when(F.col("column") == c, F.lit(float(f))) for c, f in fills.items()])
        value, count = F.col("value"), F.col("cnt")
        got = {r["column"]: (r.below or 0, r.upto or 0) for r in self._of(fills).groupBy("column").agg(
            F.sum(F.when(value < fill, count)).alias("below"), F.sum(F.when(value <= fill, count)).alias("upto")).collect()}
        return {c: got.get(c, (0, 0)) for c in fills}

    def least(self, values: dict[str, Callable[[Column], Column]]) -> dict[str, float | None]:
        x = F.coalesce(*[F.when(F.col("column") == c, f(F.col("value"))) for c, f in values.items()])
        got = {r["column"]: r.least for r in self._of(values).select("column", x.alias("x")).groupBy("column").agg(F.min("x").alias("least")).collect()}
        return {c: got.get(c) for c in values}

    def moments(self, values: dict[str, Callable[[Column], Column]], shifts: dict[str, float]) -> dict[str, dict]:
        shift = F.coalesce(*[F.when(F.col("column") == c, F.lit(float(s))) for c, s in shifts.items()])
        x = F.coalesce(*[F.when(F.col("column") == c, f(F.col("value"))) for c, f in values.items()])
        rows = self._of(values).select("column", "cnt", x.alias("x"), shift.alias("shift"))
        d, w = F.col("x") - F.col("shift"), F.col("cnt").cast("double")
        got = rows.groupBy("column").agg(
            F.sum(F.when(F.col("x").isNotNull(), F.col("cnt"))).alias("n"), F.sum(w * d).alias("s1"), F.sum(w * d * d).alias("s2"),
            F.min("x").alias("min"), F.max("x").alias("max")).collect()
        return {r["column"]: {k: r[k] for k in ("n", "s1", "s2", "min", "max")} for r in got if r.n}


def _between(values: dict, low: int, high: int, part: float) -> float:
    return values[low] + (values[high] - values[low]) * part


def _exact_fills_and_bounds(source: _Rows | _Counted, config: dict, fills: dict[str, float | None], medians: list[str], by_rank: list[str]
                            ) -> dict[tuple[str, float], float | None]:
    """Adds the medians to ``fills`` and returns the percentile bounds of the filled columns.

    A filled column has its n values and, at the fill value f, its z nulls: the rank r of the filled column is the rank r
    of the values below f, f itself, or the rank r - z of the values above. Both ranks are selected together with the
    medians, and one count of the values below and up to f tells which one holds.
    """
    names = sorted({*medians, *by_rank})
    if not names:
        return {}
    counts = source.counts(names)
    n = {c: counts[c][0] for c in names}
    nulls = {c: counts[c][1] if c in medians and n[c] or fills.get(c) is not None else 0 for c in by_rank}
    wanted: dict[str, set[int]] = {c: set() for c in names}
    for c in medians:
        if n[c]:
            wanted[c].update(rank_pair(n[c], 0.5)[:2])
    asked = {(c, q / 100.0): rank_pair(n[c] + nulls[c], q / 100.0) for c in by_rank for q in config[c]["clip"] if n[c] + nulls[c]}
    for (c, _), (low, high, _) in asked.items():
        wanted[c].update(r for x in (low, high) for r in (x, x - nulls[c]) if 0 <= r < n[c])
    found = source.ranks(wanted)
    of = {c: {r: found[c, r] for r in wanted[c]} for c in names}
    for c in medians:
        fills[c] = _between(of[c], *rank_pair(n[c], 0.5)) if n[c] else None
    shifted = [c for c in by_rank if nulls[c]]
    place = source.place({c: fills[c] for c in shifted}) if shifted else {}
    out: dict[tuple[str, float], float | None] = {(c, q / 100.0): None for c in by_rank for q in config[c]["clip"]}
    for (c, p), (low, high, part) in asked.items():
        def value(r: int, c: str = c) -> float:
            if not nulls[c]:
                return of[c][r]
            below, upto = place[c]
            if r < below:
                return of[c][r]
            return fills[c] if r < upto + nulls[c] else of[c][r - nulls[c]]
        out[c, p] = _between({low: value(low), high: value(high)}, low, high, part)
    return out


def numeric_fit(df: DataFrame, config: dict, pk: list | None = None,
                approx_accuracy: int | None = None) -> NumericModel:
    """P1. ``approx_accuracy`` (opt-in) replaces the exact ranks of medians and
    percentile bounds by ``percentile_approx`` (fixed-size sketches, rank error
    about 1/accuracy; results are data values, not interpolated), whatever the
    number of rows or distinct values."""
    cols = [c for c in df.columns if c in config]
    model = NumericModel(config={c: config[c] for c in cols}, pk=list(pk or []))
    if not cols:
        return model
    typed = materialize(df.select(*[to_double(c).alias(c) for c in cols]))
    _fit(model, cols, _Rows(typed), typed if approx_accuracy else None, approx_accuracy)
    typed.unpersist()
    return model


def numeric_state(df: DataFrame, config: dict) -> DataFrame:
    """``column, value, cnt`` of the configured columns: a fit's whole state. States of chunks add up
    (:func:`merge_counts`), so that a new chunk joins a fit without a look at the old rows."""
    return value_histogram(df, [c for c in df.columns if c in config])


def merge_counts(*states: DataFrame) -> DataFrame:
    """The counts of several states (numeric or categorical) added up."""
    merged = states[0]
    for more in states[1:]:
        merged = merged.unionByName(more)
    return merged.groupBy(*[c for c in merged.columns if c != "cnt"]).agg(F.sum("cnt").alias("cnt"))


def numeric_fit_state(state: DataFrame, config: dict, pk: list | None = None) -> NumericModel:
    """P1 from counts: the model that :func:`numeric_fit` gives for the rows behind them. Columns of ``config`` that the
    state lacks are left out."""
    known = {r[0] for r in state.select("column").distinct().collect()}
    cols = [c for c in config if c in known]
    model = NumericModel(config={c: config[c] for c in cols}, pk=list(pk or []))
    if cols:
        _fit(model, cols, _Counted(state))
    return model


def _fit(model: NumericModel, cols: list[str], source: _Rows | _Counted, typed: DataFrame | None = None,
         approx_accuracy: int | None = None) -> None:
    config = model.config

    # (1) fill values: constants as they are, mode by count (lowest value on ties), median by rank
    kinds = {c: _fill_kind(config[c]) for c in cols}
    fills: dict[str, float | None] = {c: k for c, k in kinds.items() if isinstance(k, float)}
    medians = [c for c, k in kinds.items() if k == "median"]
    modes = [c for c, k in kinds.items() if k == "mode"]
    if modes:
        got = source.modes(modes)
        fills.update({c: got.get(c, 0.0) for c in modes})

    # (2) bounds: given ones, and percentiles of the filled distribution (the null count moves onto the fill value)
    bounds = {c: tuple(map(float, config[c]["clip_abs"])) for c in cols if "clip" not in config[c] and "clip_abs" in config[c]}
    by_rank = [c for c in cols if "clip" in config[c]]
    if approx_accuracy:
        fills.update({c: v for (c, _), v in _approximate(typed, [(c, 0.5) for c in medians], {}, approx_accuracy).items()})
        found = _approximate(typed, [(c, q / 100.0) for c in by_rank for q in config[c]["clip"]], fills, approx_accuracy)
    else:
        found = _exact_fills_and_bounds(source, config, fills, medians, by_rank)
    bounds.update({c: tuple(found[(c, q / 100.0)] for q in config[c]["clip"]) for c in by_rank})
    known = {c: b for c, b in bounds.items() if None not in b}

    def clipped(c: str) -> Callable[[Column], Column]:
        def of(x: Column) -> Column:
            x = F.coalesce(x, F.lit(fills.get(c)).cast("double"))
            if c not in known:
                return x
            low, high = map(F.lit, known[c])
            return out_of_range_to_null(x, low, high) if config[c].get("clip_to_null", False) else clip(x, low, high)
        return of

    # (3) log offsets from the smallest clipped value
    logs = [c for c in cols if config[c].get("log1p", False)]
    offsets: dict[str, float] = {}
    if logs:
        least = source.least({c: clipped(c) for c in logs})
        for c in logs:
            m = least[c]
            offsets[c] = abs(m) + 1.0 if m is not None and m <= 0 else 0.0

    # (4) moments of the value before scaling in one aggregate; sums are taken around a shift (the fill value's own
    # result) so that the variance does not cancel
    def before_scale(x: float | None, c: str) -> float:
        if x is None:
            return 0.0
        if c in known:
            lo, hi = known[c]
            if config[c].get("clip_to_null", False) and not lo <= x <= hi:
                return 0.0
            x = min(max(x, lo), hi)
        if c in offsets:
            return math.log1p(x + offsets[c]) if x + offsets[c] > -1 else 0.0
        return x

    scaled = [c for c in cols if config[c].get("scale") in ("zscore", "minmax")]
    shifts = {c: before_scale(fills.get(c), c) for c in scaled}

    def unscaled(c: str) -> Callable[[Column], Column]:
        return lambda x: F.log1p(clipped(c)(x) + offsets[c]) if c in offsets else clipped(c)(x)

    moments = source.moments({c: unscaled(c) for c in scaled}, shifts) if scaled else {}

    for c in cols:
        s: dict = {"fill_value": fills.get(c)}
        if c in bounds:
            s["clip_low"], s["clip_high"] = bounds[c]
        if c in offsets:
            s["log1p_offset"] = offsets[c]
        m = moments.get(c)
        if config[c].get("scale") == "zscore":
            s["mean"] = s["std"] = None
            if m:
                s["mean"] = shifts[c] + m["s1"] / m["n"]
                if m["n"] > 1:
                    variance = 0.0 if m["min"] == m["max"] else max(m["s2"] - m["s1"] ** 2 / m["n"], 0.0) / (m["n"] - 1)
                    s["std"] = math.sqrt(variance) or 1.0
        elif config[c].get("scale") == "minmax":
            lo, hi = (m["min"], m["max"]) if m else (None, None)
            s["min"], s["max"] = lo, lo + 1.0 if lo is not None and lo == hi else hi
        model.stats[c] = s


def numeric_columns(model: NumericModel, c: str) -> Column:
    """V1-V6 for one column: the float32 transformed value."""
    cfg, s = model.config[c], model.stats[c]
    fill = F.lit(s.get("fill_value")).cast("double")
    v = F.coalesce(to_double(c), fill)
    if "clip_low" in s:
        lo, hi = s["clip_low"], s["clip_high"]
        if cfg.get("clip_to_null", False):
            v = clip_or_fill(v, lo, hi, s.get("fill_value"))
        else:
            v = clip(v, lo, hi)
    if cfg.get("log1p", False):
        v = log1p_offset(v, s.get("log1p_offset", 0.0))
    if cfg.get("scale") == "zscore":
        v = zscore(v, s.get("mean"), s.get("std"))
    elif cfg.get("scale") == "minmax":
        v = minmax(v, s.get("min"), s.get("max"))
    return v.cast("float")


def numeric_transform(df: DataFrame, model: NumericModel, pk: list | None = None) -> DataFrame:
    """PK columns, transformed columns in input order, then ``*_is_null`` flags."""
    pk = list(pk if pk is not None else model.pk)
    missing = [k for k in pk if k not in df.columns]
    if missing:
        raise KeyError(f"primary key columns missing: {missing}")
    cols = [c for c in df.columns if c in model.stats and c not in pk]
    out = [F.col(k) for k in pk]
    out += [numeric_columns(model, c).alias(c) for c in cols]
    out += [null_flag(c).alias(f"{c}_is_null") for c in cols if model.config[c].get("add_flag", False)]
    return df.select(*out)


def numeric_fit_transform(df: DataFrame, config: dict, pk: list | None = None) -> tuple[DataFrame, NumericModel]:
    """P11 without the reference's swallow-errors fallback: errors propagate."""
    model = numeric_fit(df, config, pk)
    return numeric_transform(df, model, pk), model
