"""Global ordering primitives that never funnel a whole table into one task.

``row_number()`` over an unpartitioned window moves every row into a single
task. Instead we range-partition on the ordering keys, number rows inside each
range partition, and add the size of all earlier partitions. The per-partition
size table has one row per (partition, group), so it is bounded by the number
of partitions plus the number of groups; without groups it is broadcast.

The same scheme gives weighted running totals, which drive exact quantiles
over pre-aggregated value histograms (``exact_quantiles``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tendermatch.session import materialize

_PID = "_tm_pid"
_PID_R = "_tm_pid_r"
_RUN = "_tm_run"
_OFF = "_tm_off"
_TOT = "_tm_tot"


def _as_cols(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def _range(df: DataFrame, num_partitions: int | None, keys: list[Column]) -> DataFrame:
    # Without an explicit count the cluster's shuffle sizing applies and AQE
    # may coalesce small ranges; ranges stay contiguous and ordered either way.
    return df.repartitionByRange(num_partitions, *keys) if num_partitions else df.repartitionByRange(*keys)


def _offsets(sizes: DataFrame, group_cols: list[str], extra: Sequence[str] = ()) -> DataFrame:
    """Totals of all earlier range partitions, per partition and group (one small row each)."""
    before = Window.partitionBy(*group_cols).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(F.col(_PID).alias(_PID_R), *[F.col(g).alias(f"_tm_r_{g}") for g in group_cols], *extra,
                        F.coalesce(F.sum(_TOT).over(before), F.lit(0)).alias(_OFF))


def _join_offsets(local: DataFrame, offsets: DataFrame, group_cols: list[str]) -> DataFrame:
    """Null-safe on the groups: a null group value is a group like any other. Without groups the offsets are one
    row per range partition, which is what bounds the broadcast."""
    on = F.col(_PID) == F.col(_PID_R)
    for g in group_cols:
        on = on & F.col(g).eqNullSafe(F.col(f"_tm_r_{g}"))
    side = offsets if group_cols else F.broadcast(offsets)
    return local.join(side, on).drop(_PID_R, *[f"_tm_r_{g}" for g in group_cols])


def with_running_total(df: DataFrame, order_by: Sequence[str | Column], weight: str | None = None,
                       group_by: Sequence[str] = (), name: str = "running_total",
                       num_partitions: int | None = None) -> DataFrame:
    """Inclusive running sum of the integer column ``weight`` (1 when None) in global order.

    Rows are range-partitioned; a window over (range partition, group) sums
    inside each, so that no window partition exceeds a range; the totals of the
    earlier partitions are added. The order must be total inside each group for
    a deterministic result. A null group value is a group of its own.
    """
    group_cols = list(group_by)
    order = _as_cols(order_by)
    keys = [*[F.col(g) for g in group_cols], *order]
    w = F.col(weight) if weight is not None else F.lit(1).cast("long")
    local = materialize(_range(df.withColumn(_RUN, w), num_partitions, keys).withColumn(_PID, F.spark_partition_id()))
    inside = Window.partitionBy(_PID, *group_cols).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = local.groupBy(_PID, *group_cols).agg(F.sum(_RUN).alias(_TOT))
    summed = local.withColumn(_RUN, F.sum(_RUN).over(inside))
    joined = _join_offsets(summed, _offsets(sizes, group_cols), group_cols)
    return joined.withColumn(name, F.col(_OFF) + F.col(_RUN)).drop(_PID, _RUN, _OFF)


def with_row_index(df: DataFrame, order_by: Sequence[str | Column], group_by: Sequence[str] = (),
                   name: str = "row_idx", num_partitions: int | None = None) -> DataFrame:
    """0-based row number in global ``order_by`` order (inside ``group_by``).

    One range shuffle: rows are range-partitioned and sorted inside each
    partition; ``monotonically_increasing_id`` then carries the partition
    index (upper bits) and the position inside it (lower 33 bits), so no
    window (and no second shuffle) is needed. Partition sizes (one row per
    partition and group) give the offsets.
    """
    group_cols = list(group_by)
    keys = [*[F.col(g) for g in group_cols], *_as_cols(order_by)]
    mid = F.monotonically_increasing_id()
    ranged = (_range(df, num_partitions, keys).sortWithinPartitions(*keys)
              .withColumn("_tm_mid", mid)
              .withColumn(_PID, F.shiftright("_tm_mid", 33))
              .withColumn(_RUN, F.col("_tm_mid").bitwiseAND((1 << 33) - 1))
              .drop("_tm_mid"))
    local = materialize(ranged)
    sizes = local.groupBy(_PID, *group_cols).agg(F.min(_RUN).alias("_tm_first"), F.count(F.lit(1)).alias(_TOT))
    joined = _join_offsets(local, _offsets(sizes, group_cols, ["_tm_first"]), group_cols)
    return (joined.withColumn(name, (F.col(_OFF) + F.col(_RUN) - F.col("_tm_first")).cast("long"))
            .drop(_PID, _RUN, _OFF, "_tm_first"))


def exact_quantiles(hist: DataFrame, requests: Sequence[tuple[str, float]], key: str = "column",
                    value: str = "value", count: str = "cnt") -> dict[tuple[str, float], float | None]:
    """Exact linear-interpolated quantiles from a histogram ``(key, value, cnt)``.

    Matches ``numpy.percentile`` / ``percentile_cont``: position k=(n-1)p,
    result v[floor k] + (v[ceil k]-v[floor k])*(k-floor k). Null values are
    ignored. The histogram is pre-aggregated (one row per distinct value), so
    a hot value is a single row and cannot skew the range partitioning.
    Returns a small dict (one entry per request) to the driver.
    """
    if not requests:
        return {}
    spark = hist.sparkSession
    h = hist.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).alias("v"),
                                                    F.col(count).cast("long").alias("c"))
    keys = sorted({k for k, _ in requests})
    h = h.where(F.col("k").isin(keys))
    totals = {r["k"]: int(r["n"]) for r in h.groupBy("k").agg(F.sum("c").alias("n")).collect()}
    wanted = []
    for k, p in requests:
        n = totals.get(k, 0)
        if n == 0:
            continue
        pos = (n - 1) * p
        lo = int(pos // 1)
        hi = min(lo + 1, n - 1) if pos > lo else lo
        wanted.append((k, lo))
        wanted.append((k, hi))
    if not wanted:
        return {req: None for req in requests}
    ranks = spark.createDataFrame(sorted(set(wanted)), "k string, r long")
    cum = with_running_total(h, ["v"], "c", group_by=["k"], name="cum_end")
    hits = cum.join(F.broadcast(ranks), "k")          # two rows per request
    hits = hits.where((F.col("cum_end") - F.col("c") <= F.col("r")) & (F.col("r") < F.col("cum_end")))
    at = {(r["k"], int(r["r"])): float(r["v"]) for r in hits.select("k", "r", "v").collect()}
    out: dict[tuple[str, float], float | None] = {}
    for k, p in requests:
        n = totals.get(k, 0)
        if n == 0:
            out[(k, p)] = None
            continue
        pos = (n - 1) * p
        lo = int(pos // 1)
        hi = min(lo + 1, n - 1) if pos > lo else lo
        v_lo, v_hi = at[(k, lo)], at[(k, hi)]
        out[(k, p)] = v_lo + (v_hi - v_lo) * (pos - lo)
    return out
